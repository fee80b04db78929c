"""SQL counterparts of the registered queries, for a check by another engine.

Each statement reads the base tables only. Shared steps are named fragments; a statement names
the fragment it starts from and gets those it depends on. Parameters are taken from the queries.
"""

from __future__ import annotations

from forumlens.functions.words import LEMMAS, STOP_WORDS
from forumlens.operators import keywords, neighbours, relevance, similar_posts, tuning, word_vectors
from forumlens.plans import queries as q
from forumlens.streaming import activity


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) if isinstance(v, str) else repr(v) for v in values) + "]"


_STOP = _list(STOP_WORDS)
_LEMMA = "MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in LEMMAS.items()) + "}"
_CLASSES = ", ".join(_text(c) for c in q.CLASSES)
_LAST = _text(q.CLASSES[-1])
_LANGUAGES = ", ".join(_text(c) for c in q.LANGUAGES)

_NORMALIZE = rf"""
list_filter(list_transform(list_transform(
  regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+(?:[''’]\p{{L}}+)*'),
  lambda t: regexp_replace(t, '[''’]s$', '')),
  lambda t: CASE WHEN length(t) > 1 AND t = upper(t) AND t <> lower(t) THEN t
                 ELSE coalesce({_LEMMA}[lower(t)],
                               CASE WHEN list_contains({_STOP}, lower(t)) THEN lower(t) END, t) END),
  lambda w: regexp_full_match(w, '\p{{L}}+') AND NOT list_contains({_STOP}, w))
"""

# name: (what it reads, query)
_FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "posts": ((), r"""
        SELECT d.doc_id AS id, e.user_id AS author, d.text AS title, CAST(floor(e.value) AS BIGINT) AS score,
               '/p/' || md5(regexp_replace(lower(d.text), '[^\p{L}]+', '', 'g')) AS url,
               CAST(e.props->>'$.k' AS BIGINT) AS num_comments, d.source AS subreddit,
               CAST(floor(epoch(e.ts)) AS BIGINT) AS created_utc, e.ts AS created_time,
               CASE WHEN l.doc_id IS NOT NULL THEN e.event_type END AS link_flair_text,
               d.lang AS lang, l.quality AS quality
        FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    # the recommender's corpus
    "kept": (("posts",), f"""
        SELECT * REPLACE (coalesce(link_flair_text, 'Tag Missing') AS link_flair_text) FROM posts
        WHERE link_flair_text IS DISTINCT FROM '{q.EXCLUDED}'"""),
    "one_title": (("kept",), """
        SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY title ORDER BY created_utc DESC, id) = 1"""),
    "one_url": (("one_title",), """
        SELECT * FROM one_title QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_utc DESC, id) = 1"""),
    "corpus": (("one_url",), f"""
        SELECT *, list_transform(list_filter({_NORMALIZE}, lambda w: length(w) >= 2), lambda w: lower(w)) AS terms
        FROM one_url"""),
    "tf": (("corpus",), """
        SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM corpus) GROUP BY ALL"""),
    "vocabulary": (("tf",), """
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
               ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term"""),
    "weights": (("vocabulary",), """
        SELECT id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w
        FROM tf JOIN vocabulary USING (term)"""),
    # all posts, copies too
    "a_docs": (("posts",), f"""
        SELECT id, list_transform(list_filter({_NORMALIZE}, lambda w: length(w) >= 2), lambda w: lower(w)) AS terms FROM posts"""),
    "a_tf": (("a_docs",), """
        SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM a_docs) GROUP BY ALL"""),
    "a_weights": (("a_tf",), """
        SELECT id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w
        FROM a_tf JOIN (SELECT term, ln((1 + (SELECT count(*) FROM a_docs)) / (1 + count(*))) + 1 AS idf FROM a_tf GROUP BY term) USING (term)"""),
    # the classifier's corpus, split and folds
    "c_title": (("posts",), f"""
        SELECT * FROM posts WHERE lang IN ({_CLASSES})
        QUALIFY row_number() OVER (PARTITION BY title ORDER BY created_utc DESC, id) = 1"""),
    "c_url": (("c_title",), """
        SELECT * FROM c_title QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_utc DESC, id) = 1"""),
    "labelled": (("c_url",), f"""
        SELECT id, lang AS label, list_filter({_NORMALIZE}, lambda w: length(w) >= 2) AS terms FROM c_url"""),
    "divided": (("labelled",), """
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(id || '#0'), id) - 1
                          < floor(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE + 0.5)
                       THEN 'test' ELSE 'train' END AS split FROM labelled"""),
    "folds": (("divided",), """
        SELECT id, label, terms,
               CAST((row_number() OVER (PARTITION BY label ORDER BY md5(id || '#0'), id) - 1) % 3 AS INTEGER) AS fold
        FROM divided WHERE split = 'train'"""),
    # a model of the training rows and its scores on the test rows
    "m_tf": (("divided",), """
        SELECT id, label, split, term, count(*) AS tf
        FROM (SELECT id, label, split, unnest(terms) AS term FROM divided) GROUP BY ALL"""),
    "m_vocabulary": (("m_tf",), """
        SELECT term, ln((1 + (SELECT count(*) FROM divided WHERE split = 'train')) / (1 + count(*))) + 1 AS idf
        FROM m_tf WHERE split = 'train' GROUP BY term"""),
    "m_weights": (("m_vocabulary",), """
        SELECT id, label, split, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w
        FROM m_tf JOIN m_vocabulary USING (term)"""),
    "m_classes": (("divided",), """
        SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM divided WHERE split = 'train' GROUP BY label"""),
    "m_sums": (("m_weights", "m_classes"), """
        SELECT c.label, v.term, coalesce(sum(w.w), 0) AS s FROM m_classes c CROSS JOIN m_vocabulary v
        LEFT JOIN m_weights w ON w.label = c.label AND w.term = v.term AND w.split = 'train' GROUP BY ALL"""),
    "model": (("m_sums",), """
        SELECT label, term, ln((s + 1) / (sum(s) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label))) AS logp
        FROM m_sums"""),
    "scores": (("model",), """
        SELECT d.id, d.label AS actual, c.label AS class, coalesce(sum(w.w * m.logp), 0) + any_value(c.prior) AS score
        FROM divided d CROSS JOIN m_classes c LEFT JOIN m_weights w ON w.id = d.id
        LEFT JOIN model m ON m.term = w.term AND m.label = c.label
        WHERE d.split = 'test' GROUP BY ALL"""),
    "predicted": (("scores",), """
        SELECT id, actual AS label, class AS prediction FROM scores
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, class) = 1"""),
    "probabilities": (("scores",), """
        SELECT id, actual, class, round(o, 9) AS odds, 1 / (1 + exp(-o)) AS proba FROM (
            SELECT id, actual, class, score - top - ln(sum(exp(other - top))) AS o FROM (
                SELECT a.*, b.score AS other, max(b.score) OVER (PARTITION BY a.id, a.class) AS top
                FROM scores a JOIN scores b ON b.id = a.id AND b.class <> a.class)
            GROUP BY id, actual, class, score, top)"""),
    "ranked": (("probabilities",), """
        SELECT class, odds, count(*) FILTER (actual = class) AS pos, count(*) FILTER (actual <> class) AS neg
        FROM probabilities GROUP BY ALL"""),
    "curve": (("ranked",), """
        SELECT class, odds, pos, neg, sum(pos) OVER u AS cum_pos, sum(neg) OVER u AS cum_neg,
               sum(pos) OVER a AS all_pos, sum(neg) OVER a AS all_neg FROM ranked
        WINDOW u AS (PARTITION BY class ORDER BY odds DESC), a AS (PARTITION BY class)"""),
    "cells": (("predicted",), f"""
        SELECT a.c AS label, b.c AS prediction, count(p.id) AS n
        FROM (SELECT unnest([{_CLASSES}]) AS c) a CROSS JOIN (SELECT unnest([{_CLASSES}]) AS c) b
        LEFT JOIN predicted p ON p.label = a.c AND p.prediction = b.c GROUP BY ALL"""),
    "per_class": (("cells",), """
        SELECT c AS name, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
               coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support
        FROM (SELECT c, sum(n) FILTER (label = c AND prediction = c) AS hits, sum(n) FILTER (label = c) AS support,
                     sum(n) FILTER (prediction = c) AS claimed
              FROM cells, (SELECT DISTINCT label AS c FROM cells) GROUP BY c)"""),
}


def _with(start: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _FRAGMENTS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in start.split():
        visit(name)
    parts = [(n, _FRAGMENTS[n][1]) for n in order] + list(extra)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({body})" for n, body in parts)


def _from(start: str, body: str) -> str:
    return f"{_with(start)}\n{body}"


def _cross_validation(choices: list[tuning.Choice], columns: str, keep: str, metrics: tuple[str, ...]) -> str:
    """Every choice fitted on its own in every fold; nothing is shared between choices."""
    values = ", ".join(
        f"({i}, {c.rule.min_df}, {str(isinstance(c.rule.min_df, float)).lower()}, "
        f"{c.rule.max_df}, {str(isinstance(c.rule.max_df, float)).lower()}, "
        f"{c.rule.max_features if c.rule.max_features is not None else 'NULL'}, {c.alpha})"
        for i, c in enumerate(choices))
    steps = (
        ("choices", f"""SELECT * FROM (VALUES {values})
            v(choice, min_df, min_share, max_df, max_share, max_features, alpha)"""),
        ("f", "SELECT unnest([0, 1, 2]) AS f"),
        ("f_tf", """SELECT id, label, fold, term, count(*) AS tf
            FROM (SELECT id, label, fold, unnest(terms) AS term FROM folds) GROUP BY ALL"""),
        ("f_size", "SELECT f, count(*) AS n FROM f JOIN folds ON fold <> f GROUP BY f"),
        ("f_terms", "SELECT f, term, count(*) AS df, sum(tf) AS cf FROM f JOIN f_tf ON fold <> f GROUP BY ALL"),
        ("v", """SELECT choice, alpha, f, term, ln((1 + n) / (1 + df)) + 1 AS idf
            FROM choices CROSS JOIN f_terms JOIN f_size USING (f)
            WHERE df >= CASE WHEN min_share THEN min_df * n ELSE min_df END
              AND df <= CASE WHEN max_share THEN max_df * n ELSE max_df END
            QUALIFY max_features IS NULL
                 OR row_number() OVER (PARTITION BY choice, f ORDER BY cf DESC, term) <= max_features"""),
        ("x", """SELECT choice, alpha, f, id, label, fold <> f AS training, term,
                   tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY choice, f, id)) AS w
            FROM f_tf JOIN v USING (term)"""),
        ("s", """SELECT choice, alpha, f, term, class, coalesce(sum(w) FILTER (label = class AND training), 0) AS s
            FROM x CROSS JOIN (SELECT DISTINCT label AS class FROM folds) GROUP BY ALL"""),
        ("lp", """SELECT choice, f, term, class, ln((s + alpha)
                   / (sum(s) OVER (PARTITION BY choice, f, class) + alpha * count(*) OVER (PARTITION BY choice, f, class)))
                   AS logp FROM s"""),
        ("prior", """SELECT f, label AS class, ln(count(*) / any_value(n)) AS prior
            FROM f JOIN folds ON fold <> f JOIN f_size USING (f) GROUP BY f, label"""),
        ("ll", """SELECT choice, f, id, class, sum(w * logp) AS ll FROM x JOIN lp USING (choice, f, term)
            GROUP BY ALL"""),
        ("sc", """SELECT choice, f, id, label, fold <> f AS training, class, coalesce(ll, 0) + prior AS score
            FROM choices CROSS JOIN prior CROSS JOIN folds LEFT JOIN ll USING (choice, f, id, class)"""),
        ("pr", """SELECT choice, f, id, any_value(label) AS label, training,
                   arg_min(class, {'s': -round(score, 9), 'c': class}) AS prediction,
                   round(max(score) FILTER (class = """ + _LAST + """) - max(score) FILTER (class <> """ + _LAST + """), 9)
                   AS odds
            FROM sc GROUP BY choice, f, id, training"""),
        ("acc", """SELECT choice, f, training, 'accuracy' AS metric, avg(CAST(label = prediction AS DOUBLE)) AS value
            FROM pr GROUP BY ALL"""),
        ("pn", f"""SELECT choice, f, training, odds, count(*) FILTER (label = {_LAST}) AS pos,
                   count(*) FILTER (label <> {_LAST}) AS neg FROM pr GROUP BY ALL"""),
        ("auc", """SELECT choice, f, training, 'roc_auc' AS metric,
                   sum(neg * (cum - pos / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS value
            FROM (SELECT *, sum(pos) OVER (PARTITION BY choice, f, training ORDER BY odds DESC) AS cum FROM pn)
            GROUP BY choice, f, training"""),
        ("measured", f"""SELECT m.choice, m.f, training, metric, CASE WHEN e.choice IS NOT NULL THEN value END AS value
            FROM ({" UNION ALL ".join(f"SELECT * FROM {m}" for m in metrics)}) m
            LEFT JOIN (SELECT DISTINCT choice, f FROM v) e ON e.choice = m.choice AND e.f = m.f"""),
        ("summary", """SELECT choice, metric,
                   CASE WHEN count(*) FILTER (NOT training AND value IS NULL) = 0 THEN round(avg(value) FILTER (NOT training), 6) END AS valid_avg, CASE WHEN count(*) FILTER (training AND value IS NULL) = 0 THEN round(avg(value) FILTER (training), 6) END AS train_avg,
                   CASE WHEN count(*) FILTER (NOT training AND value IS NULL) = 0 THEN round(stddev_pop(value) FILTER (NOT training), 6) END AS valid_sd,
                   CASE WHEN count(*) FILTER (training AND value IS NULL) = 0 THEN round(stddev_pop(value) FILTER (training), 6) END AS train_sd
            FROM measured GROUP BY choice, metric"""),
    )
    return f"""{_with('folds', steps)}
        SELECT {keep}{columns} valid_avg, train_avg, valid_sd, train_sd FROM summary JOIN choices USING (choice)"""


_GRID_COLUMNS = """CAST(coalesce(max_features, 0) AS INTEGER) AS max_features, CAST(max_df AS DOUBLE) AS max_df,
    CAST(min_df AS DOUBLE) AS min_df, CAST(alpha AS DOUBLE) AS alpha,"""


def _sweep(name: str, values) -> str:
    choices = [tuning.Choice(tuning.VocabularyRule(**{name: v})) for v in values]
    return _cross_validation(choices, f"CAST({name} AS DOUBLE) AS param,", "metric, ", ("acc", "auc"))


def _fitted(vocabulary: str, alpha: str) -> tuple[tuple[str, str], ...]:
    """A model of the training rows on a vocabulary given by conditions on df, rank and n."""
    return (
        ("n_vocabulary", f"""SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
                SELECT term, count(*) AS df, sum(tf) AS cf, (SELECT count(*) FROM divided WHERE split = 'train') AS n
                FROM m_tf WHERE split = 'train' GROUP BY term) {vocabulary}"""),
        ("n_weights", """SELECT id, label, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w
            FROM m_tf JOIN n_vocabulary USING (term) WHERE split = 'train'"""),
        ("n_sums", """SELECT c.label, v.term, any_value(v.idf) AS idf, coalesce(sum(w.w), 0) AS s
            FROM m_classes c CROSS JOIN n_vocabulary v
            LEFT JOIN n_weights w ON w.label = c.label AND w.term = v.term GROUP BY ALL"""),
        ("n_model", f"""SELECT label, term, idf, ln((s + {alpha})
                / (sum(s) OVER (PARTITION BY label) + {alpha} * count(*) OVER (PARTITION BY label))) AS logp
            FROM n_sums"""),
    )


def _pruned(rule: tuning.VocabularyRule) -> str:
    return f"""WHERE df >= {rule.min_df} AND df <= {rule.max_df} * n
        QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= {rule.max_features}"""


def _stream_scores() -> str:
    steps = _fitted(_pruned(q.TUNED.rule), repr(q.TUNED.alpha)) + (
        ("arriving", f"SELECT id, list_filter({_NORMALIZE}, lambda w: length(w) >= 2) AS terms FROM posts"),
        ("a_tf", "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM arriving) GROUP BY ALL"),
        ("a_weights", """SELECT id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w
            FROM a_tf JOIN n_vocabulary USING (term)"""),
        ("a_scores", """SELECT a.id, c.label, coalesce(sum(w.w * m.logp), 0) + any_value(c.prior) AS score
            FROM arriving a CROSS JOIN m_classes c LEFT JOIN a_weights w ON w.id = a.id
            LEFT JOIN n_model m ON m.term = w.term AND m.label = c.label GROUP BY ALL"""),
    )
    return f"""{_with("m_tf m_classes", steps)} SELECT id, label AS prediction FROM a_scores
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, label) = 1"""


def _final_steps() -> tuple[tuple[str, str], ...]:
    """The grid's best vocabulary, then its best alpha, then the model of all training rows."""
    grid = tuning.vocabulary_grid()
    keep = "choice, max_features, max_df, min_df, alpha, "
    by_vocabulary = _cross_validation(grid, "", keep, ("acc",))
    each_pair = _cross_validation([tuning.Choice(c.rule, a) for c in grid for a in tuning.GRID_ALPHA], "", keep, ("acc",))
    return (
        ("best", f"SELECT * FROM ({by_vocabulary}) ORDER BY round(valid_avg, 9) DESC, choice LIMIT 1"),
        ("alphas", f"""SELECT a.* FROM ({each_pair}) a JOIN best b
            ON a.max_features = b.max_features AND a.max_df = b.max_df AND a.min_df = b.min_df
            ORDER BY round(a.valid_avg, 9) DESC, a.choice LIMIT 1"""),
    ) + _fitted("""CROSS JOIN (SELECT min_df, max_df, max_features FROM best) WHERE df >= min_df AND df <= max_df * n
        QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= any_value(max_features) OVER ()""",
                "(SELECT CAST(alpha AS DOUBLE) FROM alphas)")


def _train_final() -> str:
    return f"""{_with("m_tf m_classes", _final_steps())}
        SELECT label, term, round(idf, 6) AS idf, round(logp, 6) AS logp FROM n_model"""


def _evaluated_final(last: tuple[str, ...], body: str) -> str:
    """A query on fragments that read ``scores``, here those of the final model on the test rows."""
    steps = _final_steps() + (
        ("t_weights", """SELECT id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w
            FROM m_tf JOIN n_vocabulary USING (term) WHERE split = 'test'"""),
        ("scores", """SELECT d.id, d.label AS actual, c.label AS class,
                coalesce(sum(w.w * m.logp), 0) + any_value(c.prior) AS score
            FROM divided d CROSS JOIN m_classes c LEFT JOIN t_weights w ON w.id = d.id
            LEFT JOIN n_model m ON m.term = w.term AND m.label = c.label WHERE d.split = 'test' GROUP BY ALL"""),
    ) + tuple((name, _FRAGMENTS[name][1]) for name in last)
    return f"{_with('m_tf m_classes', steps)}\n{body}"


def _indexed_neighbours() -> str:
    """The index built anew: digits of hashes as directions, codes of each set, buckets of pairs of sets, votes."""
    s = neighbours.Shape()
    block, digits = neighbours.COMPONENTS_PER_HASH, neighbours.DIGITS_PER_COMPONENT
    return f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
        directions AS MATERIALIZED (SELECT r, i, list_transform(range(64), lambda j: list_sum(list_transform(range({digits}),
                lambda c: CAST('0x' || substr(md5(r || '/' || i || '/' || (j // {block})), {digits} * (j % {block}) + c + 1, 1) AS INT))) - {neighbours.MIDDLE}) AS g
            FROM range({s.rotations}) a(r), range({s.directions}) b(i)),
        along AS MATERIALIZED (SELECT id, r, i, list_inner_product(q, g::DOUBLE[]) AS x
            FROM (SELECT id, list_transform(e, lambda x: floor({neighbours.SCALE} * x)) AS q FROM v), directions),
        codes AS MATERIALIZED (SELECT id, r, code, row_number() OVER (PARTITION BY id, r ORDER BY x DESC, code) AS place
            FROM (SELECT id, r, i AS code, x FROM along UNION ALL SELECT id, r, i + {s.directions}, -x FROM along)
            QUALIFY place <= {s.probes}),
        buckets AS (SELECT a.id, a.r, d, a.code * {2 * s.directions} + b.code AS code, a.place AS p1, b.place AS p2
            FROM codes a, range(1, {s.partners} + 1) t(d), codes b WHERE b.id = a.id AND b.r = (a.r + d) % {s.rotations}),
        met AS (SELECT p.id AS target, x.id FROM buckets p JOIN buckets x ON x.r = p.r AND x.d = p.d AND x.code = p.code AND x.p1 = 1 AND x.p2 = 1
            WHERE p.id % {q.EVERY} = 0 AND p.id <> x.id GROUP BY ALL HAVING count(*) >= {s.votes})
        SELECT target, a.id, round(list_cosine_similarity(a.e, b.e), 6) AS sim,
            CAST(row_number() OVER (PARTITION BY target ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, a.id) AS INTEGER) AS rank
        FROM met JOIN v a ON a.id = met.id JOIN v b ON b.id = target QUALIFY rank <= 5"""


_ACTIVITY = """SELECT time_bucket(INTERVAL 1 HOUR, created_time) AS window_start,
    time_bucket(INTERVAL 1 HOUR, created_time) + INTERVAL 1 HOUR AS window_end, subreddit AS tag, count(*) AS n_posts,
    CAST(sum(num_comments) AS BIGINT) AS n_comments, max(score) AS top_score FROM posts GROUP BY ALL"""


_VECTOR_STEPS = (
    ("docs", f"SELECT id, {_NORMALIZE} AS words FROM posts"),
    ("uses", """SELECT id, word, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
        FROM (SELECT id, unnest(list_distinct(words)) AS word FROM docs) JOIN embeddings ON vec_id = id"""),
    ("word_vectors", "SELECT word, i, avg(x) AS x FROM uses GROUP BY ALL"),
    ("tokens", "SELECT id, unnest(words) AS word FROM docs"),
    ("means", "SELECT id, i, avg(x) AS x FROM tokens JOIN word_vectors USING (word) GROUP BY ALL"),
    ("packed", "SELECT id, list(x ORDER BY i) AS vector FROM means GROUP BY id"),
)


def _mean_vectors() -> str:
    return f"""{_with('posts', _VECTOR_STEPS)}
        SELECT id, list_transform(vector, lambda x: round(x, 6)) AS vector FROM docs LEFT JOIN packed USING (id)"""


def _words_vector_top5() -> str:
    return f"""{_with('posts', _VECTOR_STEPS)} SELECT id, author, title, subreddit, link_flair_text, cosine_sim FROM posts
        JOIN (SELECT a.id, round(coalesce(list_cosine_similarity(a.vector, b.vector), 0), 6) AS cosine_sim
              FROM (SELECT id, vector FROM docs LEFT JOIN packed USING (id)) a
              JOIN packed b ON b.id = {q.TARGET} AND a.id <> {q.TARGET} ORDER BY cosine_sim DESC, id LIMIT 5) USING (id)"""


def _statements() -> dict[str, str]:
    from_posts = lambda body: _from("posts", body)
    search_columns = """id, author, title, score, url, num_comments, subreddit, created_utc, created_time,
        link_flair_text"""
    live = "title, score, id, subreddit, url, num_comments, selftext AS body, created_time"
    with_bodies = """(SELECT posts.*, selftext FROM posts LEFT JOIN (
            SELECT conv_id, min(text) AS selftext FROM conversations WHERE turn = 0 GROUP BY conv_id) ON conv_id = id)"""
    live_keyword = f"contains(lower(concat_ws(' ', title, selftext)), {_text(q.KEYWORD)})"
    types = "CASE typeof({}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"
    tags = ", ".join(_text(t) for t in q.TAGS)
    wide = ", ".join(f"count(*) FILTER (link_flair_text = {_text(t)}) AS \"{t}\"" for t in q.TAGS)
    pivoted = f"""SELECT num_comments, {wide} FROM posts
        WHERE link_flair_text IN ({tags}) AND num_comments IS NOT NULL GROUP BY num_comments"""
    keyword = f"contains(lower(title), {_text(q.KEYWORD)})"
    both = f"""SELECT author, count(*) FILTER (lang = {_text(q.CLASSES[0])}) AS n_posts_tag1,
            count(*) FILTER (lang = {_text(q.CLASSES[1])}) AS n_posts_tag2
        FROM posts WHERE author IS NOT NULL GROUP BY author HAVING n_posts_tag1 > 0 AND n_posts_tag2 > 0"""
    columns = ("id", "author", "title", "score", "url", "num_comments", "subreddit", "created_utc", "created_time",
               "link_flair_text", "lang", "quality")
    profiled = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {types.format(f'any_value({c})')} AS column_type, count(*) AS n_rows, count({c}) AS non_null FROM posts"
        for c in columns)
    report = """
            SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class
            UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                CAST(sum(support) AS BIGINT) FROM per_class
            UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                CAST(sum(support) AS BIGINT) FROM per_class"""
    auc = """SELECT class,
            round(sum(neg * (cum_pos - pos / 2)) / (CAST(any_value(all_pos) AS DOUBLE) * any_value(all_neg)), 6) AS auc
            FROM curve GROUP BY class"""
    return {
        "search_posts": from_posts(f"""SELECT {search_columns} FROM posts
            WHERE subreddit = 'src0' AND {keyword} AND created_utc > {q.AFTER}
            ORDER BY created_utc DESC, id LIMIT 20"""),
        "search_keyword_in_channel": from_posts(f"""SELECT {live} FROM {with_bodies}
            WHERE subreddit = 'src0' AND {live_keyword}"""),
        "search_stored_posts": from_posts(f"""SELECT id, author, CAST(created_time AS DATE) AS day, subreddit, created_utc, title FROM posts
            WHERE subreddit = 'src0' AND created_utc > {q.AFTER} AND created_utc < {q.BEFORE} ORDER BY created_utc DESC, id LIMIT 50"""),
        "posts_on_busy_days": from_posts("""SELECT id, day, subreddit, author FROM (
                SELECT *, CAST(created_time AS DATE) AS day, count(*) OVER (PARTITION BY CAST(created_time AS DATE)) AS n FROM posts)
            WHERE n > (SELECT count(*) / count(DISTINCT CAST(created_time AS DATE)) FROM posts)"""),
        "scan_channel": from_posts("SELECT * FROM posts WHERE subreddit = 'src0'"),
        "scan_channel_two_tags": from_posts(
            f"SELECT * FROM posts WHERE subreddit = 'src0' AND link_flair_text IN ({tags})"),
        "filter_time_range": from_posts(f"""SELECT id, created_utc, title FROM posts
            WHERE created_utc > {q.AFTER} AND created_utc < {q.BEFORE}"""),
        "filter_keyword": from_posts(f"SELECT id, title FROM posts WHERE {keyword}"),
        "project_display": from_posts(
            "SELECT author, id, title, url, subreddit, link_flair_text, created_time FROM posts"),
        "exclude_tag_null_safe": from_posts(f"""SELECT id, link_flair_text FROM posts
            WHERE link_flair_text IS DISTINCT FROM '{q.EXCLUDED}'"""),
        "fill_missing_tag": from_posts(
            "SELECT id, coalesce(link_flair_text, 'Tag Missing') AS link_flair_text FROM posts"),
        "epoch_and_time": from_posts("""SELECT id, created_utc, strftime(created_time, '%Y-%m-%d %H:%M:%S') AS created_text,
            CAST(epoch(date_trunc('day', created_time)) AS BIGINT) AS day_utc FROM posts"""),
        "count_by_tag": from_posts("""SELECT link_flair_text, count(*) AS n_posts FROM posts
            WHERE link_flair_text IS NOT NULL GROUP BY 1"""),
        "share_by_tag": from_posts("""SELECT link_flair_text,
            round(count(*) / (SELECT count(*) FROM posts) * 100, 6) AS share_pct
            FROM posts WHERE link_flair_text IS NOT NULL GROUP BY 1"""),
        "posts_by_num_comments": from_posts("SELECT num_comments, count(*) AS n_posts FROM posts GROUP BY 1"),
        "posts_by_comments_tag": from_posts("""SELECT num_comments, link_flair_text, count(*) AS n_posts FROM posts
            WHERE link_flair_text IS NOT NULL GROUP BY ALL"""),
        "pivot_comments_by_tag": from_posts(pivoted),
        "unpivot_comments_by_tag": from_posts(" UNION ALL ".join(
            f"SELECT num_comments, '{t}' AS link_flair_text, \"{t}\" AS n_posts FROM ({pivoted})" for t in q.TAGS)),
        "distinct_authors": from_posts("""SELECT count(DISTINCT author) + coalesce(max(CAST(author IS NULL AS INT)), 0)
            AS n_authors FROM posts"""),
        "distinct_tags": from_posts("SELECT DISTINCT link_flair_text FROM posts"),
        "duplicate_counts": from_posts("""SELECT (SELECT count(*) FROM posts) - (SELECT count(*) FROM (SELECT DISTINCT title FROM posts)) AS dup_title,
            (SELECT count(*) FROM posts) - (SELECT count(*) FROM (SELECT DISTINCT url FROM posts)) AS dup_url"""),
        "dup_id_violations":
            "SELECT conv_id, count(*) AS n_rows FROM conversations GROUP BY conv_id HAVING count(*) > 1",
        "dedupe_title_then_url": from_posts("""SELECT * FROM (SELECT * FROM posts
            QUALIFY row_number() OVER (PARTITION BY title ORDER BY created_utc DESC, id) = 1)
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_utc DESC, id) = 1"""),
        "avg_words_by_tag": from_posts(r"""SELECT link_flair_text,
            round(avg(len(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> ''))), 6) AS avg_words
            FROM posts WHERE link_flair_text IS NOT NULL GROUP BY 1"""),
        "avg_words_overall": from_posts(r"""SELECT
            round(avg(len(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> ''))), 6) AS avg_words FROM posts"""),
        "avg_words_normalized_by_tag": from_posts(f"""SELECT link_flair_text, round(avg(len({_NORMALIZE})), 6) AS avg_words
            FROM posts WHERE link_flair_text IS NOT NULL GROUP BY 1"""),
        "avg_posts_per_author_tag": from_posts("""SELECT round(avg(n), 6) AS avg_posts FROM (
            SELECT count(*) AS n FROM posts WHERE author IS NOT NULL AND link_flair_text IS NOT NULL
            GROUP BY author, link_flair_text)"""),
        "authors_both_tags": from_posts(both),
        "authors_both_tags_top5": from_posts(f"{both} ORDER BY n_posts_tag1 DESC, n_posts_tag2 DESC, author LIMIT 5"),
        "table_profile": from_posts(profiled),
        "thread_comment_stats": """SELECT conv_id, count(*) FILTER (turn > 0) AS n_comments,
            arg_min(text, turn) FILTER (turn > 0) AS first_comment FROM conversations GROUP BY conv_id""",
        "upsert_ignore": from_posts("""SELECT id, author, CASE WHEN link_flair_text IS NULL THEN score + 1000 ELSE score END
            AS score, num_comments, created_time, link_flair_text FROM posts"""),
        "keyed_set_latest": """SELECT user_id, event_id, ts, event_type, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "normalize_titles": from_posts(f"SELECT id, array_to_string({_NORMALIZE}, ' ') AS preprocs_title FROM posts"),
        "tfidf_weights": _from("weights", "SELECT id, term, round(w, 6) AS w FROM weights"),
        "vocab_pruned": _from("vocabulary", f"""SELECT term, df, cf, round(idf, 6) AS idf FROM vocabulary
            WHERE df >= {q.PRUNED.min_df} AND df <= {q.PRUNED.max_df} * (SELECT count(*) FROM corpus)
            ORDER BY cf DESC, term LIMIT {q.PRUNED.max_features}"""),
        "vocab_size": _from("tf", "SELECT count(DISTINCT term) AS n_terms FROM tf"),
        "recommend_tfidf_top5": _from("weights", f"""SELECT id, author, title, subreddit, link_flair_text,
            round(coalesce(sim, 0), 6) AS consine_sim FROM corpus LEFT JOIN (
                SELECT a.id, sum(a.w * b.w) AS sim FROM weights a JOIN weights b ON a.term = b.term AND b.id = {q.TARGET}
                GROUP BY a.id) USING (id)
            WHERE id <> {q.TARGET} ORDER BY consine_sim DESC, id LIMIT 5"""),
        "recommend_tfidf_for": _from("weights", f""", sims AS (SELECT a.id AS x, b.id AS y, sum(a.w * b.w) AS sim
                FROM weights a JOIN weights b USING (term) WHERE a.id % {q.EVERY} = 0 AND a.id <> b.id GROUP BY ALL)
            SELECT a.id AS target, b.id, round(coalesce(sim, 0), 6) AS sim,
                CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(coalesce(sim, 0), 6) DESC, b.id) AS INTEGER) AS rank
            FROM corpus a JOIN corpus b ON a.id <> b.id AND a.id % {q.EVERY} = 0 LEFT JOIN sims ON x = a.id AND y = b.id
            QUALIFY rank <= 5"""),
        "doc_vectors_mean": _mean_vectors(),
        "recommend_vector_top5": from_posts(f"""SELECT id, author, title, subreddit, link_flair_text, cosine_sim FROM posts
            JOIN (SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine_sim
                  FROM embeddings a JOIN embeddings b ON b.vec_id = {q.TARGET} AND a.vec_id <> {q.TARGET}
                  WHERE a.vec_id IN (SELECT id FROM posts) ORDER BY cosine_sim DESC, id LIMIT 5) USING (id)"""),
        "recommend_words_vector_top5": _words_vector_top5(),
        "stratified_split": _from("divided", "SELECT id, label, split FROM divided"),
        "split_label_counts": _from("divided", "SELECT split, label, count(*) AS n FROM divided GROUP BY ALL"),
        "stratified_folds": _from("folds", "SELECT id, label, fold FROM folds"),
        "nb_model": _from("model", """SELECT label, term, round(logp, 6) AS logp, round(prior, 6) AS prior
            FROM model JOIN m_classes USING (label)"""),
        "nb_predict": _from("predicted", "SELECT id, label, prediction FROM predicted"),
        "nb_predict_proba": _from("probabilities", "SELECT id, class, round(proba, 6) AS proba FROM probabilities"),
        "accuracy": _from("predicted",
                          "SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM predicted"),
        "confusion_matrix": _from("cells", "SELECT label, prediction, n FROM cells"),
        "classification_report": _from("per_class", report),
        "roc_points": _from("curve", """SELECT class, round(1 / (1 + exp(-odds)), 6) AS threshold, round(cum_neg / all_neg, 6) AS fpr,
                round(cum_pos / all_pos, 6) AS tpr FROM curve
            UNION ALL SELECT DISTINCT class, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM curve"""),
        "roc_auc": _from("curve", auc),
        "cv_report": _cross_validation([tuning.Choice()], "", "metric, ", ("acc", "auc")),
        "tune_max_features": _sweep("max_features", tuning.SWEEP_MAX_FEATURES),
        "tune_max_df": _sweep("max_df", tuning.SWEEP_MAX_DF),
        "tune_min_df": _sweep("min_df", tuning.SWEEP_MIN_DF),
        "tuning_curves": f"""SELECT metric, param, part, score FROM (
            SELECT metric, param, unnest(['valid_avg', 'train_avg']) AS part, unnest([valid_avg, train_avg]) AS score
            FROM ({_sweep("min_df", tuning.SWEEP_MIN_DF)}) WHERE metric = 'accuracy')""",
        "grid_vocab": _cross_validation(tuning.vocabulary_grid(), _GRID_COLUMNS,
                                        "CAST(choice AS INTEGER) AS choice, ", ("acc",)),
        "grid_alpha": _cross_validation([tuning.Choice(q.PRUNED, a) for a in tuning.GRID_ALPHA], _GRID_COLUMNS,
                                        "CAST(choice AS INTEGER) AS choice, ", ("acc",)),
        "grid_unreachable": _cross_validation(q.UNREACHABLE, _GRID_COLUMNS, "CAST(choice AS INTEGER) AS choice, ", ("acc",)),
        "train_final": _train_final(),
        "final_confusion": _evaluated_final(("predicted", "cells"), "SELECT label, prediction, n FROM cells"),
        "final_report": _evaluated_final(("predicted", "cells", "per_class"), report),
        "final_roc_auc": _evaluated_final(("probabilities", "ranked", "curve"), auc),
        "stream_scores": _stream_scores(),
        "recommend_vector_indexed": _indexed_neighbours(),
        "similar_post_classes": _from("a_weights", f""", links AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM a_weights a JOIN a_weights b USING (term)
                WHERE a.id <> b.id GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= {similar_posts.LIKE}),
            reach AS (SELECT id AS x, id AS y FROM a_docs UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
            SELECT d.id, (SELECT min(y) FROM reach WHERE x = d.id) AS class_id, (SELECT count(*) FROM links WHERE x = d.id) AS n_links
            FROM a_docs d""").replace("WITH ", "WITH RECURSIVE ", 1),
        "relevance_to_abstracts": _from("weights", f""", items AS (SELECT item_id, unnest(list_transform(list_filter(
                {_NORMALIZE}, lambda w: length(w) >= 2), lambda w: lower(w))) AS term FROM (SELECT item_id, text AS title FROM benchmark)),
            asked AS (SELECT item_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)) AS w
                FROM (SELECT item_id, term, count(*) AS tf FROM items GROUP BY ALL) JOIN vocabulary USING (term))
            SELECT item_id AS query, id, round(sum(a.w * b.w), 6) AS sim,
                CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sum(a.w * b.w), 6) DESC, id) AS INTEGER) AS rank
            FROM asked a JOIN weights b USING (term) GROUP BY item_id, id QUALIFY rank <= {relevance.TOP}"""),
        "spread_between_channels": from_posts("""SELECT from_channel, to_channel, count(*) AS n_hops, CAST(sum(delay) AS BIGINT) AS total_delay,
                min(delay) AS least_delay, max(delay) AS most_delay FROM (
            SELECT p.id, p.subreddit AS to_channel, q.subreddit AS from_channel, p.created_utc - q.created_utc AS delay
            FROM (SELECT a.*, c.subreddit AS other FROM (SELECT *, row_number() OVER (ORDER BY created_utc, id) AS k FROM posts) a
                  JOIN (SELECT DISTINCT url, subreddit FROM posts) c ON c.url = a.url AND c.subreddit <> a.subreddit) p
            ASOF JOIN (SELECT *, row_number() OVER (ORDER BY created_utc, id) AS k FROM posts) q
                ON q.url = p.url AND q.subreddit = p.other AND p.k > q.k
            QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY q.k DESC) = 1) GROUP BY ALL"""),
        "activity_closed": from_posts(f"""SELECT * FROM ({_ACTIVITY})
            WHERE window_end <= (SELECT max(created_time) FROM posts) - INTERVAL {activity.DELAY}"""),
        "activity_current": from_posts(_ACTIVITY),
        "tag_for_term": from_posts(f"""SELECT link_flair_text, count(*) AS n_posts FROM posts
            WHERE contains(array_to_string({_NORMALIZE}, ' '), 'eau') AND link_flair_text IS NOT NULL
            GROUP BY 1 ORDER BY n_posts DESC, 1 LIMIT 1"""),
        "stream_search": from_posts(f"SELECT {live} FROM {with_bodies} WHERE subreddit = 'src0' AND {live_keyword}"),
        "stream_keyed_set": """SELECT user_id, event_id, ts, event_type, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "languages_bayes_report": _from("per_class", report).replace(_CLASSES, _LANGUAGES),
        "languages_bayes_auc": _from("curve", auc).replace(_CLASSES, _LANGUAGES),
        "nested_comment_stats": """SELECT conv_id AS id, count(*) AS n_comments, arg_min(text, turn) AS first_comment FROM conversations
            WHERE turn > 0 GROUP BY conv_id""",
        "word_cooccurrences": _from("a_docs", f""", places AS MATERIALIZED (SELECT id, unnest(terms) AS word, generate_subscripts(terms, 1) AS place FROM a_docs),
            used AS (SELECT word FROM places GROUP BY word HAVING count(*) >= {word_vectors.MIN_COUNT}),
            beside AS (SELECT x.word AS a, y.word AS b FROM places x JOIN places y ON x.id = y.id AND y.place > x.place
                AND y.place < x.place + {word_vectors.WINDOW} WHERE x.word IN (FROM used) AND y.word IN (FROM used))
            SELECT word, context, CAST(count(*) AS BIGINT) AS n FROM (SELECT a AS word, b AS context FROM beside UNION ALL SELECT b, a FROM beside) GROUP BY ALL"""),
        "abstract_keywords": f"""WITH RECURSIVE items AS MATERIALIZED (SELECT item_id AS id, {_NORMALIZE} AS words
                FROM (SELECT item_id, text AS title FROM benchmark)),
            places AS MATERIALIZED (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM items),
            beside AS (SELECT x.id, x.word AS a, y.word AS b FROM places x JOIN places y ON x.id = y.id AND x.word <> y.word
                AND y.place > x.place AND y.place < x.place + {keywords.WINDOW}),
            shares AS MATERIALIZED (SELECT id, a, b, n / sum(n) OVER (PARTITION BY id, a) AS share FROM (
                SELECT id, a, b, count(*) AS n FROM (SELECT * FROM beside UNION ALL SELECT id, b, a FROM beside) GROUP BY ALL)),
            ranks AS (SELECT DISTINCT 0 AS k, id, a AS word, 1.0::DOUBLE AS rank FROM shares
                UNION ALL SELECT k + 1, r.id, s.b, {1 - keywords.DAMPING} + {keywords.DAMPING} * sum(r.rank * s.share)
                FROM ranks r JOIN shares s ON s.id = r.id AND s.a = r.word WHERE k < 150 GROUP BY k, r.id, s.b)
            SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(rank, 6) DESC, word) AS INTEGER) AS place, word, round(rank, 6) AS rank
            FROM ranks WHERE k = 150 QUALIFY place <= {keywords.WORDS}""",
        "stream_insert_if_absent": from_posts("""SELECT id, author,
            CASE WHEN link_flair_text IS NULL THEN score + 1000 ELSE score END AS score, created_utc, link_flair_text FROM posts"""),
    }


def statements() -> dict[str, str]:
    """The SQL of every query that has one, by the query's name."""
    return _statements()
