"""Cross-validation, parameter sweeps and grid search for the text classifier.

Folds and parameter choices run side by side in one set of jobs, each in columns of its own.
Vocabulary and idf of a fold come from its training rows only, obtained as totals minus the
fold's own counts, so terms are counted once however many folds there are. Choices that
lead to the same vocabulary are fitted once. Terms are counted, models fitted and posts scored in blocks of posts, so no
posting is a row of a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.operators.bayes import SCORE_DIGITS, class_sizes
from forumlens.operators.ordering import running_totals
from forumlens.operators.tfidf import VocabularyRule, dealt, in_blocks, smooth_idf
from forumlens.session import stage

MEASURES = ("accuracy", "roc_auc")

# Sums carried side by side in one pass over the posts, and numbers that all terms of a pass have together.
MAX_SUMS = 512
MAX_NUMBERS = 1 << 24

# First letters by which equally frequent terms are counted before they are ranked.
TIE_LETTERS = 3

# The parameter ranges searched.
SWEEP_MAX_FEATURES = (50, 100, 150, 200, 250, 300)
SWEEP_MAX_DF = (0.5, 0.7, 0.9)
SWEEP_MIN_DF = (2, 3, 5, 10)
GRID_ALPHA = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


@dataclass(frozen=True)
class Choice:
    """One point of a search: a vocabulary rule and a smoothing strength."""

    rule: VocabularyRule = VocabularyRule()
    alpha: float = 1.0


def vocabulary_grid(max_features=SWEEP_MAX_FEATURES, max_df=SWEEP_MAX_DF, min_df=SWEEP_MIN_DF) -> list[Choice]:
    """All combinations, in the order in which a tie is decided for the earlier one."""
    return [Choice(VocabularyRule(lo, hi, n)) for hi, n, lo in product(max_df, max_features, min_df)]


def _number(value) -> str:
    """A Python number or flag as an SQL literal of the same type and value."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return str(value)


def _exprs(texts) -> list[Column]:
    return [F.expr(t) for t in texts]


def _literal_structs(rows: list[dict]) -> Column:
    """One output row per given row of numbers."""
    structs = (", ".join(f"'{k}', {_number(v)}" for k, v in row.items()) for row in rows)
    return F.expr(f"explode(array({', '.join(f'named_struct({s})' for s in structs)}))")


def _fold_sizes(docs: DataFrame) -> DataFrame:
    """Training posts per fold: one row per fold."""
    sizes = docs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    return sizes.select("fold", (total - F.col("n")).alias("n_train"))


def _training_terms(docs: DataFrame, n_folds: int) -> DataFrame:
    """Frequencies of each term in the training rows of each fold (fold, term, df, cf).

    Terms are counted inside blocks of posts; rows of one id, label and fold are one post.
    """
    # a function of its own, so that executors need not have this package
    def count(posts: pa.Table) -> pa.Table:
        lists = posts["_terms"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        n = max(len(coded.dictionary), 1)
        post, folds = np.zeros(len(posts), np.int64), posts["fold"].combine_chunks().dictionary_encode(null_encoding="encode")
        for c in ("id", "label", "fold"):
            own = posts[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            post = np.unique(post * (own.max(initial=0) + 1) + own, return_inverse=True)[1].reshape(-1)
        fold_of = np.zeros(int(post.max(initial=-1)) + 1, np.int64)
        fold_of[post] = folds.indices.to_numpy()
        entry, tf = np.unique(np.repeat(post, sizes) * n + coded.indices.to_numpy(), return_counts=True)
        key, place = np.unique(fold_of[entry // n] * n + entry % n, return_inverse=True)
        return pa.table({"term": coded.dictionary.take(pa.array(key % n)), "fold": folds.dictionary.take(pa.array(key // n)).cast(pa.int32()),
                         "df": np.bincount(place, minlength=len(key)).astype(np.int64), "cf": np.bincount(place, weights=tf, minlength=len(key)).astype(np.int64)})

    counted = dealt(docs, ("id", "label", "fold")).groupBy("block").applyInArrow(count, "term string, fold int, df long, cf long")
    sums = [F.sum("df").alias("df"), F.sum("cf").alias("cf")]
    for f in range(n_folds):
        sums += [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("df", "cf")]
    per_term = counted.groupBy("term").agg(*sums)
    trained = F.explode(F.array(*[
        F.struct(F.lit(f).alias("fold"), (F.col("df") - F.col(f"df{f}")).alias("df"),
                 (F.col("cf") - F.col(f"cf{f}")).alias("cf")) for f in range(n_folds)
    ])).alias("s")
    return per_term.select("term", trained).select("s.fold", "term", "s.df", "s.cf").where("df > 0")


def _vocabularies(terms: DataFrame, sizes: DataFrame, rules: list[VocabularyRule]) -> DataFrame:
    """Terms of each rule in each fold (rule, fold, term, idf).

    Rules that differ in size only share one ranking. It is cut inside the tasks before the shuffle, where Spark does
    that for a ranking of this size, and else to the terms that can be among the first.
    """
    limits = sorted({(r.min_df, r.max_df) for r in rules}, key=str)
    tagged = [{"limits": i, "min_df": float(lo), "max_df": float(hi),
               "min_share": isinstance(lo, float), "max_share": isinstance(hi, float)}
              for i, (lo, hi) in enumerate(limits)]
    n = F.col("n_train")
    with_limits = terms.join(F.broadcast(sizes), "fold").select("*", _literal_structs(tagged).alias("p")).where(
        (F.col("df") >= F.when(F.col("p.min_share"), F.col("p.min_df") * n).otherwise(F.col("p.min_df")))
        & (F.col("df") <= F.when(F.col("p.max_share"), F.col("p.max_df") * n).otherwise(F.col("p.max_df")))
    ).select("fold", "term", "cf", F.col("p.limits").alias("limits"), smooth_idf(n, F.col("df")).alias("idf"))

    def chosen(found: DataFrame, which: list[int]) -> DataFrame:
        picks = [{"rule": i, "of": limits.index((rules[i].min_df, rules[i].max_df)),
                  "size": rules[i].max_features or 0} for i in which]
        cut = F.lit(True) if "rank" not in found.columns else F.col("rank") <= F.col("q.size")
        return found.select("*", _literal_structs(picks).alias("q")).where(
            (F.col("limits") == F.col("q.of")) & cut).select(F.col("q.rule").alias("rule"), "fold", "term", "idf")

    sized = [i for i, r in enumerate(rules) if r.max_features is not None]
    unsized = [i for i, r in enumerate(rules) if r.max_features is None]
    parts = []
    if sized:
        order = Window.partitionBy("limits", "fold").orderBy(F.desc("cf"), "term")
        largest = max(rules[i].max_features for i in sized)
        setting = terms.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
        leading = with_limits if largest <= int(setting) else _leading(stage(with_limits), largest)
        ranked = leading.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= largest)
        parts.append(chosen(ranked, sized))
    if unsized:
        parts.append(chosen(with_limits, unsized))
    return reduce(DataFrame.unionByName, parts)


def _leading(terms: DataFrame, size: int) -> DataFrame:
    """The terms that can be among the ``size`` most frequent of their (limits, fold), ties by term.

    All terms above the frequency at which ``size`` is reached stay, and of that frequency those whose first letters come
    early enough. Only counts of distinct frequencies and of first letters are ordered, never the vocabulary.
    """
    group = ["limits", "fold"]

    def counted(rows: DataFrame, by: str, order: Column, *more: str) -> DataFrame:
        running = Window.partitionBy(*group).orderBy(order)
        return rows.groupBy(*group, by, *more).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(running))

    cut = counted(terms, "cf", F.desc("cf")).where(F.col("upto") >= size).groupBy(*group).agg(
        F.max("cf").alias("cut"), F.max_by(F.col("upto") - F.col("n"), "cf").alias("before"))
    placed = terms.join(F.broadcast(cut), group, "left")  # a row per choice of limits and fold
    ties = placed.where(F.col("cf") == F.col("cut")).withColumn("letters", F.substring("term", 1, TIE_LETTERS))
    last = counted(ties, "letters", F.col("letters"), "before").where(F.col("upto") + F.col("before") >= size).groupBy(
        *group).agg(F.min("letters").alias("last"))
    early = ties.join(F.broadcast(last), group).where(F.col("letters") <= F.col("last"))
    above = placed.where(F.col("cut").isNull() | (F.col("cf") > F.col("cut")))
    return above.select(*terms.columns).unionByName(early.select(*terms.columns))


def _distinct_vocabularies(vocabularies: DataFrame) -> DataFrame:
    """(rule, fold, model, n): the first rule with the same terms in the fold stands for all of them; ``n`` is their number.

    Two rules agree in a fold when number, sum and xor of their terms' hashes agree.
    """
    h = F.xxhash64("term")
    prints = vocabularies.groupBy("rule", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    firsts = prints.groupBy("fold", "n", "s", "x").agg(F.min("rule").alias("model"))
    return prints.join(firsts, ["fold", "n", "s", "x"]).select("rule", "fold", "model", "n")


def _passes(fitted: list[tuple[int, int, int]], sums: int) -> list[list[tuple[int, int]]]:
    """The (model, fold) pairs of each pass, from pairs with their numbers of terms and the sums that each pair needs."""
    passes, numbers = [[]], 0
    for model, fold, n in fitted:
        if passes[-1] and ((len(passes[-1]) + 1) * sums > MAX_SUMS or numbers + n * (sums + 1) > MAX_NUMBERS):
            passes.append([])
            numbers = 0
        passes[-1].append((model, fold))
        numbers += n * (sums + 1)
    return passes


def _scored_counts(docs: DataFrame, models: DataFrame, fitted: list[tuple[int, int, int]],
                   classes: list, alphas: list[float], n_folds: int, by_odds: bool) -> DataFrame:
    """Posts per (model, fold, part, alpha, label, prediction), and per log-odds of the last class if these are wanted."""
    counted = [_one_pass(docs, models, p, classes, alphas, n_folds, by_odds) for p in _passes(fitted, len(classes) * len(alphas))]
    return reduce(DataFrame.unionByName, counted)


def _one_pass(docs: DataFrame, models: DataFrame, slots: list[tuple[int, int]],
              classes: list, alphas: list[float], n_folds: int, by_odds: bool) -> DataFrame:
    """Fit and score some (model, fold) pairs, named by their position, side by side in blocks of posts.

    A term has a list of what it is in each pair, so the posts are not multiplied by the number of models. Posts without an id are not learnt
    from and keep the priors, as do those without a term of a model; rows with one id are scored together. Of scores, ``SCORE_DIGITS`` digits count.
    """
    n_classes, n_alphas, digits = len(classes), len(alphas), SCORE_DIGITS
    fold_of = [fold for _, fold in slots]
    priors = np.array(_fold_priors(docs, classes, n_folds), float)
    names = docs.sparkSession.range(1).select(_literal_structs(
        [{"slot": k, "model": m, "fold": f} for k, (m, f) in enumerate(slots)]).alias("s")).select("s.*")
    known = stage(models.join(F.broadcast(names), ["model", "fold"]).select("slot", "term", "idf"))

    # functions of their own, so that executors need not have this package
    def entries(posts: pa.Table, post: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Place of the id (-1: null) and of the label (last: null), and fold of each row; the row's post, term and count of each entry."""
        names = posts["id"].combine_chunks()
        ids = names.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        null = names.is_null().to_numpy(zero_copy_only=False)
        labels = posts["label"].combine_chunks()
        own = pc.fill_null(pc.index_in(labels, value_set=pa.array(classes, labels.type)), n_classes).to_numpy(zero_copy_only=False).astype(np.int64)
        fold = pc.fill_null(posts["fold"].combine_chunks().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        group = np.unique(np.stack((ids, own, fold), axis=1), axis=0, return_inverse=True)[1].reshape(-1) if len(ids) else ids
        first = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
        first[group] = np.arange(len(group))
        here = ~null[post]
        entry, tf = np.unique(group[post[here]] * n + place[here], return_counts=True)
        return np.where(null, -1, ids), own, fold, first[entry // n], entry % n, tf

    def by_slot(known: pa.Table) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
        """What the terms are in the pairs, ordered by pair; their places among the terms, and where each pair begins."""
        lists = known["models"].combine_chunks()
        each = lists.flatten()
        term = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        slot = each.field("slot").to_numpy(zero_copy_only=False)
        order = np.argsort(slot, kind="stable")
        return each.take(pa.array(order)), term[order], slot[order], np.searchsorted(slot[order], np.arange(len(fold_of) + 1))

    def weighed(ids, row, term, tf, n, its_terms, idf):
        """The entries of one pair's terms: which ones, their weights and the lengths of all ids."""
        weight = np.zeros(n)
        weight[its_terms] = idf
        some = np.flatnonzero(weight[term])
        x = tf[some] * weight[term[some]]
        return some, x, np.sqrt(np.bincount(ids[row[some]], weights=x * x, minlength=int(ids.max(initial=0)) + 1))

    def sums_of_block(posts: pa.Table, known: pa.Table, post: np.ndarray, place: np.ndarray) -> pa.Table:
        n = max(len(known), 1)
        ids, own, fold, row, term, tf = entries(posts, post, place, n)
        each, its_term, its_slot, begin = by_slot(known)
        idf = each.field("idf").to_numpy(zero_copy_only=False)
        sums = np.zeros((n_classes, len(idf)))
        occurs = np.bincount(term, minlength=n) > 0
        for k, f in enumerate(fold_of):
            part = slice(begin[k], begin[k + 1])
            some, x, length = weighed(ids, row, term, tf, n, its_term[part], idf[part])
            rows = row[some]
            w = x / length[ids[rows]]
            for i in range(n_classes):
                mine = (own[rows] == i) & (fold[rows] != f) & (fold[rows] >= 0)
                sums[i, part] = np.bincount(term[some[mine]], weights=w[mine], minlength=n)[its_term[part]]
        there = occurs[its_term]
        return pa.table({"slot": pa.array(its_slot[there], pa.int32()), "term": known["term"].combine_chunks().take(pa.array(its_term[there])),
                         **{f"w{i}": sums[i, there] for i in range(n_classes)}})

    # fit: weights of the training rows per class and term
    each_class = [f"w{i}" for i in range(n_classes)]
    listed = stage(known.groupBy("term").agg(F.collect_list(F.struct("slot", "idf")).alias("models")))
    in_block = in_blocks(docs, listed, sums_of_block, ", ".join(["slot int, term string", *(f"{c} double" for c in each_class)]),
                         keep=("id", "label", "fold"))
    sums = stage(in_block.groupBy("slot", "term").agg(*(F.sum(c).alias(c) for c in each_class)).join(known, ["slot", "term"]))
    totals = stage(sums.groupBy("slot").agg(F.count(F.lit(1)).alias("terms"), *(F.sum(c).alias(f"all_{c}") for c in each_class)))
    logps = F.array(*_exprs(f"ln((w{i} + {_number(a)}) / (all_w{i} + {_number(a)} * terms))" for i in range(n_classes) for a in alphas))
    scoring = stage(sums.join(F.broadcast(totals), "slot").select("term", F.struct("slot", "idf", logps.alias("logps")).alias("m"))
                    .groupBy("term").agg(F.collect_list("m").alias("models")))

    def counts_of_block(posts: pa.Table, known: pa.Table, post: np.ndarray, place: np.ndarray) -> pa.Table:
        n = max(len(known), 1)
        ids, own, fold, row, term, tf = entries(posts, post, place, n)
        each, its_term, _, begin = by_slot(known)
        idf = each.field("idf").to_numpy(zero_copy_only=False)
        logps = each.field("logps").flatten().to_numpy(zero_copy_only=False).reshape(len(idf), n_classes * n_alphas)
        found = []
        for k, f in enumerate(fold_of):
            part = slice(begin[k], begin[k + 1])
            some, x, length = weighed(ids, row, term, tf, n, its_term[part], idf[part])
            weight = np.zeros((n, n_classes * n_alphas))
            weight[its_term[part]] = logps[part]
            scores = np.stack([np.bincount(ids[row[some]], weights=x * weight[term[some], c], minlength=len(length))
                               for c in range(n_classes * n_alphas)], axis=1)
            scores = np.divide(scores, length[:, None], out=np.zeros(scores.shape), where=length[:, None] > 0)
            scores = np.where(ids[:, None] >= 0, scores[ids] if len(scores) else 0.0, 0.0).reshape(len(ids), n_classes, n_alphas) + priors[f][None, :, None]
            for j in range(n_alphas):
                best = np.round(scores[:, :, j], digits).argmax(axis=1)
                code = (own * 2 + (fold == f)) * n_classes + best
                if by_odds:
                    with np.errstate(invalid="ignore"):
                        odds = np.round(scores[:, 1, j] - scores[:, 0, j], digits) + 0.0  # one zero, without a sign
                else:
                    odds = np.zeros(len(code))
                for c in np.unique(code):
                    values, counts = np.unique(odds[code == c], return_counts=True)
                    found.append((np.full(len(values), k), np.full(len(values), j), np.full(len(values), c), values, counts))
        slot, alpha, code, odds, counts = (np.concatenate(c) for c in zip(*found))
        label, kind = pa.array([*classes, None], posts["label"].type), pa.array(classes, posts["label"].type)
        return pa.table({"slot": pa.array(slot, pa.int32()), "alpha": pa.array(np.array(alphas, float)[alpha]),
                         "part": pa.array(["train", "valid"]).take(pa.array(code // n_classes % 2)),
                         "label": label.take(pa.array(code // n_classes // 2)), "prediction": kind.take(pa.array(code % n_classes)),
                         "odds": odds, "n": counts.astype(np.int64)})

    # score: a post without a term of a model keeps the prior
    kind = docs.schema["label"].dataType.simpleString()
    scored = in_blocks(docs, scoring, counts_of_block, f"slot int, alpha double, part string, label {kind}, prediction {kind}, odds double, n long",
                       keep=("id", "label", "fold"))
    return scored.join(F.broadcast(names), "slot").groupBy(
        "model", "fold", "part", "alpha", "label", "prediction", *(["odds"] if by_odds else [])).agg(F.sum("n").alias("n"))


def _fold_priors(docs: DataFrame, classes: list, n_folds: int) -> list[list[float]]:
    """Log share of each class in the training rows of each fold."""
    sizes = {(r["fold"], r["label"]): r["n"]
             for r in docs.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    priors = []
    for fold in range(n_folds):
        trained = [sum(n for (own, label), n in sizes.items() if own != fold and label == c) for c in classes]
        priors.append([math.log(n / sum(trained)) if n else -math.inf for n in trained])
    return priors


def fold_measures(docs: DataFrame, choices: list[Choice], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Each measure on the validation and training part of each fold, for every choice.

    ``docs`` holds (id, label, fold, terms). Returns (choice, fold, part, metric, value) with a row for each of them;
    the value is NULL where the fold's vocabulary is empty or the measure is not defined.
    """
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    classes = list(class_sizes(docs))
    if "roc_auc" in measures and len(classes) != 2:
        raise ValueError("roc_auc needs exactly two classes")
    n_folds = docs.agg(F.max("fold")).first()[0] + 1
    rules = list(dict.fromkeys(c.rule for c in choices))
    alphas = list(dict.fromkeys(c.alpha for c in choices))
    terms = _training_terms(docs, n_folds)
    vocabularies = stage(_vocabularies(terms, _fold_sizes(docs), rules))
    assigned = stage(_distinct_vocabularies(vocabularies))
    fitted = sorted(map(tuple, assigned.select("model", "fold", "n").distinct().collect()))
    models = vocabularies.withColumnRenamed("rule", "model")
    counts = stage(_scored_counts(docs, models, fitted, classes, alphas, n_folds, by_odds="roc_auc" in measures))
    group = ["model", "fold", "part", "alpha"]
    results = []
    if "accuracy" in measures:
        right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
        results.append(counts.groupBy(*group).agg((right / F.sum("n")).alias("value"))
                       .withColumn("metric", F.lit("accuracy")))
    if "roc_auc" in measures:
        positive = F.col("label") == F.lit(classes[-1])
        split = counts.groupBy(*group, "odds").agg(
            F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
            F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("neg"))
        totals = running_totals(split, group, "odds", {"pos": "pos", "neg": "neg"})
        area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
        results.append(totals.groupBy(*group).agg(
            F.try_divide(area, F.max("all_pos").cast("double") * F.max("all_neg")).alias("value"))
            .withColumn("metric", F.lit("roc_auc")))
    per_model = reduce(DataFrame.unionByName, results)
    wanted = [{"choice": i, "rule": rules.index(c.rule), "alpha": c.alpha} for i, c in enumerate(choices)]
    every = docs.sparkSession.range(n_folds).select(
        F.col("id").cast("int").alias("fold"), _literal_structs(wanted).alias("c")).select("fold", "c.*")
    for name, values in (("part", ("train", "valid")), ("metric", measures)):
        every = every.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    plan = every.join(assigned.drop("n"), ["rule", "fold"], "left")  # no model where no term is left
    return plan.join(per_model, ["model", "fold", "alpha", "part", "metric"], "left").select(
        "choice", "fold", "part", "metric", "value")


def summarise(measured: DataFrame) -> DataFrame:
    """Mean and population standard deviation over folds (choice, metric, valid_*, train_*).

    NULL where a fold has no value: a mean over fewer folds would not compare with the others.
    """
    def over(part: str, fn) -> Column:
        own = F.col("part") == part
        return F.when(F.count_if(own & F.col("value").isNull()) == 0, fn(F.when(own, F.col("value"))))
    return measured.groupBy("choice", "metric").agg(
        over("valid", F.avg).alias("valid_avg"), over("train", F.avg).alias("train_avg"),
        over("valid", F.stddev_pop).alias("valid_sd"), over("train", F.stddev_pop).alias("train_sd"))


def cross_validate(docs: DataFrame, choice: Choice = Choice(), measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row per measure: mean and deviation on validation and training folds."""
    return summarise(fold_measures(docs, [choice], measures)).drop("choice")


def _with_parameters(summary: DataFrame, rows: list[dict]) -> DataFrame:
    table = summary.sparkSession.range(1).select(
        _literal_structs([{"choice": i, **row} for i, row in enumerate(rows)]).alias("p")).select("p.*")
    return summary.join(F.broadcast(table), "choice")


def tune_one(docs: DataFrame, measures: tuple[str, ...] = MEASURES, *, max_features=None, max_df=None,
             min_df=None) -> DataFrame:
    """Cross-validate each value of one vocabulary parameter; the value is in ``param``.

    Of several parameters given, the first of max_features, max_df and min_df is used.
    """
    given = [(n, v) for n, v in (("max_features", max_features), ("max_df", max_df), ("min_df", min_df)) if v]
    if not given:
        raise ValueError("give values for max_features, max_df or min_df")
    name, values = given[0]
    choices = [Choice(VocabularyRule(**{name: v})) for v in values]
    summary = summarise(fold_measures(docs, choices, measures))
    return _with_parameters(summary, [{"param": float(v)} for v in values]).drop("choice")


def grid_search(docs: DataFrame, choices: list[Choice]) -> DataFrame:
    """Accuracy of every choice with its parameters; ``choice`` is the position in the list."""
    summary = summarise(fold_measures(docs, choices, ("accuracy",))).drop("metric")
    rows = [{"max_features": c.rule.max_features or 0, "max_df": float(c.rule.max_df),
             "min_df": float(c.rule.min_df), "alpha": c.alpha} for c in choices]
    return _with_parameters(summary, rows)


def best_choice(searched: DataFrame, choices: list[Choice]) -> Choice:
    """The choice with the highest mean validation accuracy; the earlier one on a tie. Choices without one come last."""
    best = searched.orderBy(F.desc_nulls_last(F.round("valid_avg", SCORE_DIGITS)), "choice").first()
    return choices[best["choice"]]
