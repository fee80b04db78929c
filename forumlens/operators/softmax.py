"""Softmax regression on TF-IDF weights, for any number of classes.

A linear model of the same form as naive Bayes (a table of terms with one number per class, and one number per class), so
predictions, probabilities, reports and areas of one class against the rest come from the same code. The regularised loss is
minimised by conjugate gradients over tables: a step joins the weights to the residuals of the posts and sums by term for the gradient, joins them to
the direction and sums by post for how scores move, and finds the length of the step by one aggregation that has the loss of all lengths in a
grid as columns. Sums per class are plain columns that shrink inside the tasks; sums of a few numbers reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.operators.bayes import NaiveBayesModel, class_sizes
from forumlens.operators.tfidf import VocabularyRule, corpus_size, fit_vocabulary, term_counts, weights
from forumlens.session import stage

#: Lengths tried in each step, times the last one.
LENGTHS = tuple(2.0 ** k for k in range(-6, 5))


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)


def _plus(a: Column, b: Column, times: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.lit(times) * y)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _log_total(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def residuals(scored: DataFrame) -> DataFrame:
    """(id, r): probability less 1 for the post's own class, of posts (id, own: number of the class, scores)."""
    total = _log_total(F.col("scores"))
    return scored.select("id", F.transform("scores", lambda s, k: F.exp(s - total) - F.when(k == F.col("own"), 1.0).otherwise(0.0)).alias("r"))


def _summed(rows: DataFrame, by: str, column: str, name: str, n: int) -> DataFrame:
    """(by, name): the arrays ``column`` of length ``n`` times the weights ``w``, summed; sums are plain numbers, so rows are not sorted for them."""
    sums = rows.groupBy(by).agg(*(F.sum(F.get(column, F.lit(k)) * F.col("w")).alias(f"_s{k}") for k in range(n)))
    return sums.select(by, F.array(*(f"_s{k}" for k in range(n))).alias(name))


def gradient(unit_weights: DataFrame, of_posts: DataFrame, coefficients: DataFrame, penalty: float, n: int | None = None) -> DataFrame:
    """(term, g): the gradient of the loss by the coefficients (term, b), from residuals (id, r) and weights (id, term, w).

    ``n`` is the number of classes, looked up if it is not given.
    """
    n = (of_posts.agg(F.max(F.size("r"))).first()[0] or 0) if n is None else n
    sums = _summed(unit_weights.join(of_posts, "id"), "term", "r", "s", n)
    return coefficients.join(sums, "term").select("term", _plus(F.col("s"), F.col("b"), penalty).alias("g"))


def _moves(unit_weights: DataFrame, direction: DataFrame, scored: DataFrame, shift: np.ndarray) -> DataFrame:
    """``scored`` with the change of scores per unit of a step (``move``)."""
    sums = _summed(unit_weights.join(direction, "term"), "id", "d", "m", len(shift))
    by_all = F.array(*(F.lit(float(x)) for x in shift))
    return scored.join(sums, "id", "left").select("id", "own", "scores", _plus(F.coalesce("m", _zeros(len(shift))), by_all).alias("move"))


def _losses(moved: DataFrame, lengths: list[float]) -> np.ndarray:
    """The loss of all posts after a step of each length, without the penalty."""
    def loss(t: float) -> Column:
        scores = _plus(F.col("scores"), F.col("move"), t)
        return F.sum(_log_total(scores) - F.element_at(scores, F.col("own") + 1))

    return np.array(moved.agg(*(loss(t).alias(f"l{k}") for k, t in enumerate(lengths))).first(), float)


def fit(docs: DataFrame, rule: VocabularyRule = VocabularyRule(), penalty: float = 1.0, steps: int = 40,
        tolerance: float = 1e-4) -> NaiveBayesModel:
    """Fit on rows (id, label, terms); rows without a label are left out.

    Ends when a step lowers the loss by less than the share ``tolerance``, or after ``steps``. The intercepts are not penalised.
    """
    sizes = class_sizes(docs)
    classes, n = list(sizes), len(sizes)
    known = docs.where(F.col("label").isNotNull())
    postings = term_counts(known)
    vocabulary = stage(fit_vocabulary(postings, corpus_size(known), rule).select("term", "idf"))
    if n < 2:
        return NaiveBayesModel(vocabulary.withColumn("logp", F.array(*[F.lit(0.0)] * n)), classes, [0.0] * n)
    unit_weights = stage(weights(postings, vocabulary, docs=known))
    own = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("label")).cast("int") - 1
    intercepts = np.log(np.array(list(sizes.values()), float) / sum(sizes.values()))
    scored = stage(known.select("id", own.alias("own"), F.array(*(F.lit(float(x)) for x in intercepts)).alias("scores")))
    state = stage(vocabulary.select("term", _zeros(n).alias("b"), _zeros(n).alias("d"), _zeros(n).alias("g")))
    shift, old_shift, old_square, last, loss = np.zeros(n), np.zeros(n), 0.0, 1.0, None
    for _ in range(steps):
        found = stage(state.withColumnRenamed("g", "before").join(gradient(
            unit_weights, stage(residuals(scored)), state.select("term", "b"), penalty, n), "term"))
        by_all = np.array(residuals(scored).agg(*(F.sum(F.get("r", F.lit(k))).alias(f"r{k}") for k in range(n))).first(), float)
        sums = found.agg(*(F.coalesce(F.sum(_dot(F.col(a), F.col(b))), F.lit(0.0)).alias(a + b) for a, b in
                           (("g", "g"), ("g", "before"), ("b", "b")))).first()
        square = sums["gg"] + by_all @ by_all
        turn = max(0.0, (square - sums["gbefore"] - by_all @ old_shift) / old_square) if old_square else 0.0
        directed = stage(found.select("term", "b", "g", _plus(F.transform("g", lambda x: -x), F.col("d"), turn).alias("d")))
        shift, old_shift, old_square = -by_all + turn * shift, by_all, square
        moved = stage(_moves(unit_weights, directed.select("term", "d"), scored, shift))
        sizes_of = directed.agg(*(F.coalesce(F.sum(_dot(F.col(a), F.col(b))), F.lit(0.0)).alias(a + b) for a, b in (("b", "d"), ("d", "d")))).first()
        lengths = [0.0, *(last * x for x in LENGTHS)]
        t = np.array(lengths)
        losses = _losses(moved, lengths) + penalty / 2 * (sums["bb"] + 2 * t * sizes_of["bd"] + t * t * sizes_of["dd"])
        best = int(losses.argmin())
        loss = losses[0]
        if best == 0 or not math.isfinite(losses[best]):
            last /= 2.0 ** 10
            if last < 1e-12:
                break
            state, old_square = directed.select("term", "b", _zeros(n).alias("d"), "g"), 0.0
            shift = np.zeros(n)
            continue
        last = lengths[best]
        state = stage(directed.select("term", _plus(F.col("b"), F.col("d"), last).alias("b"), "d", "g"))
        scored = stage(moved.select("id", "own", _plus(F.col("scores"), F.col("move"), last).alias("scores")))
        intercepts = intercepts + last * shift
        if loss - losses[best] <= tolerance * loss:
            break
    return NaiveBayesModel(stage(state.select("term", F.col("b").alias("logp")).join(vocabulary, "term")), classes, intercepts.tolist())
