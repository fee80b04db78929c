import math

import pytest
from pyspark.sql import functions as F

from forumlens.operators import similarity, tfidf
from forumlens.operators.tfidf import VocabularyRule
from forumlens.plans import pipelines
from forumlens.session import stage
from tests import helpers


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, terms array<string>")


def tables(df, rule=VocabularyRule()):
    return pipelines.tfidf_tables(df, rule)


@pytest.fixture(scope="module")
def docs():
    made = helpers.random_docs(1, 60)
    made[60] = []                      # no term at all
    made[61] = list(made[3])           # exact copies, in another order
    made[62] = list(reversed(made[3]))
    made[63] = made[3] + ["extra"]
    return made


def test_weights_match_a_plain_computation(spark, docs):
    expected, idf = helpers.tfidf(docs)
    df = frame(spark, docs)
    postings, vocabulary = tables(df)
    got = {(r["id"], r["term"]): r["w"] for r in tfidf.weights(postings, vocabulary).collect()}
    assert got.keys() == {(i, t) for i, ws in expected.items() for t in ws}
    assert all(got[i, t] == pytest.approx(expected[i][t], abs=1e-12) for i, t in got)
    lengths = tfidf.weights(postings, vocabulary).groupBy("id").agg(F.sum(F.col("w") ** 2).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in lengths)
    assert {r["term"]: r["idf"] for r in vocabulary.collect()} == pytest.approx(idf)


def test_vocabulary_rules(spark):
    df = frame(spark, {1: ["a", "a", "a", "b", "c"], 2: ["a", "b", "d", "d"], 3: ["a", "e"], 4: []})
    names = lambda **rule: sorted(r["term"] for r in tables(df, VocabularyRule(**rule))[1].collect())
    assert names() == ["a", "b", "c", "d", "e"]
    assert names(max_df=1.0) == ["a", "b", "c", "d", "e"]      # a share: all posts, not one
    assert names(max_df=1) == ["c", "d", "e"]                  # a count
    assert names(max_df=0.5) == ["b", "c", "d", "e"]
    assert names(min_df=2) == ["a", "b"] and names(min_df=0.75) == ["a"] and names(min_df=1.0) == []
    assert names(max_features=2) == ["a", "b"]                 # corpus counts 5, 2, 2: tie by name
    assert names(max_features=1, max_df=0.5) == ["b"]


def brute_neighbours(docs, k):
    weights, _ = helpers.tfidf(docs)
    best = {}
    for i in docs:
        sims = [(-round(helpers.dot(weights[i], weights[j]), 6), j) for j in docs if j != i]
        best[i] = [(j, -s) for s, j in sorted(sims)[:k]]
    return best


def test_neighbours_of_given_posts(spark, docs):
    df = frame(spark, docs)
    expected = brute_neighbours(docs, 5)
    targets = df.where("id in (0, 3, 17, 60, 61)")
    found = {}
    for r in similarity.recommend_for(df, tfidf.weights(*tables(df)), targets).orderBy("target", "rank").collect():
        found.setdefault(r["target"], []).append((r["id"], pytest.approx(r["sim"], abs=1e-6)))
    assert found == {i: expected[i] for i in (0, 3, 17, 60, 61)}
    assert [j for j, _ in expected[61]][:2] == [3, 62]          # copies first, by id, never itself


def test_neighbours_of_one_post(spark, docs):
    df = frame(spark, docs)
    expected = brute_neighbours(docs, 5)
    for target in (3, 60, 61, 17):
        got = similarity.recommend_by_tfidf(df, *tables(df), target).collect()
        assert [(r["id"], pytest.approx(r["sim"], abs=1e-6)) for r in got] == expected[target]
    posts = df.withColumn("title", F.lit("t"))
    similar = similarity.recommend_by_tfidf(df, *tables(df), 61)
    attached = similarity.attach_posts(similar, posts, ("id", "title")).collect()
    assert [r["id"] for r in attached] == [j for j, _ in expected[61]]
    assert attached[0]["consine_sim"] == 1.0


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])],
                                    "id long, vector array<float>")
    got = similarity.recommend_by_vector(vectors, 1).collect()
    assert [(r["id"], r["sim"]) for r in got] == [(2, 1.0), (4, round(math.sqrt(0.5), 6)), (3, 0.0)]


def test_document_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["unknown"]), (3, [])], "id long, words array<string>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>")
    got = {r["id"]: r["vector"] for r in similarity.document_vectors(docs, words).collect()}
    assert got[1] == pytest.approx([1 / 3, 2.0]) and got[2] is None and got[3] is None


def test_mean_vectors_in_blocks_move_no_vector_per_word(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_POSTS", 7)
    texts = helpers.random_docs(5, 60)
    rows = [(i, [str(t) for t in terms]) for i, terms in texts.items()] + [(3, ["wab", "none"]), (None, ["waa"]), (99, None)]
    vectors = {f"wa{c}": [float(k), 1.0 / (k + 1)] for k, c in enumerate("abcdefghij")}
    known = spark.createDataFrame([*vectors.items(), ("wak", None)], "word string, vector array<double>")
    found = similarity.document_vectors(spark.createDataFrame(rows, "id long, words array<string>"), known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ObjectHashAggregate" not in plan
    expected = {}
    for i, words in rows:
        expected.setdefault(i, []).extend(vectors[w] for w in words or [] if w in vectors)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is None or not expected[r["id"]]:
            assert r["vector"] is None
        else:
            assert r["vector"] == pytest.approx([sum(x) / len(x) for x in zip(*expected[r["id"]])])


def test_mean_vectors_read_word_vectors_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_POSTS", 5)
    monkeypatch.setattr(similarity, "BLOCK_VECTORS", 2)  # several batches
    docs = spark.createDataFrame([(i, [f"w{i % 7}", None, "unknown", f"w{i % 3}"]) for i in range(20)] + [(30, None), (31, [])], "id long, words array<string>")
    known = spark.createDataFrame([(f"w{k}", [float(k), 1.0]) for k in range(7)], "word string, vector array<double>")
    found = similarity.document_vectors(docs, known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "word#" not in plan  # neither words nor their vectors are dealt
    got = {r["id"]: r["vector"] for r in found.collect()}
    assert got == {**{i: [(i % 7 + i % 3) / 2, 1.0] for i in range(20)}, 30: None, 31: None}


def test_means_are_plain_sums(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 0.5]), ("a", None), ("b", [4.0, 4.0])], "word string, v array<float>")
    means = similarity.mean_by(rows, "word", "v", 2)
    assert "ObjectHashAggregate" not in means._jdf.queryExecution().executedPlan().toString()
    assert helpers.rows(means) == [("a", [2.0, 1.25]), ("b", [4.0, 4.0])]


def test_hot_terms_are_split_in_a_merge_join(spark):
    """Without a broadcast, adaptive execution splits the partition of a term that every post has."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # keep several map tasks
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(0, 20000, 1, 8).selectExpr("id", "array('hot', concat('t', id)) terms")
        postings, vocabulary = tables(df)
        summed = tfidf.raw_weights(postings, vocabulary).groupBy("id").agg(F.sum("x").alias("x"))
        assert len(summed.collect()) == 20000
        assert "SortMergeJoin(skew=true)" in summed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_weights_of_blocks_of_posts(spark, docs, monkeypatch):
    """With the posts at hand no posting is a row of a shuffle; posts with one id, odd terms and odd rows count as they do in postings."""
    rows = [*docs.items(), (3, ["extra", "two\nlines"]), (70, None), (71, ["x y", None, "", ""]), (72, [""]), (None, ["wab", "extra"])]
    df = stage(spark.createDataFrame(rows, "id long, terms array<string>"))
    postings, vocabulary = tables(df)
    in_rows = tfidf.weights(postings, vocabulary).collect()
    for words in (tfidf.BLOCK_WORDS, 40):
        monkeypatch.setattr(tfidf, "BLOCK_WORDS", words)
        in_blocks = tfidf.weights(postings, vocabulary, docs=df)
        got = {(r.id, r.term): r.w for r in in_blocks.collect()}
        assert got == pytest.approx({(r.id, r.term): r.w for r in in_rows}) and len(got) == len(in_rows)
    plan = in_blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "CoGroupsInArrow" in plan


def test_terms_move_as_one_string(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a"]), (2, ["two\nlines", "a"]), (3, []), (4, None), (5, ["", ""]), (6, [None, "a"])]
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    counts = tfidf.term_counts(df)
    assert {(r.id, r.term): r.tf for r in counts.collect()} == {
        (1, "a"): 3, (1, "b"): 1, (2, "two\nlines"): 1, (2, "a"): 1, (5, ""): 2, (6, None): 1, (6, "a"): 1}
    assert "array_join" in counts._jdf.queryExecution().optimizedPlan().toString()
