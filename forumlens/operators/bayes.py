"""Multinomial naive Bayes on TF-IDF weights.

A model is a table of terms (term, idf, logp), where ``logp`` holds one log-probability per class
in the order of the classes, and the classes with their priors. Word probabilities are smoothed by
``alpha``; the prior is the plain share of each class. Classes are columns throughout, so neither
fitting nor scoring multiplies the postings by their number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.operators.tfidf import VocabularyRule, corpus_size, fit_vocabulary, in_blocks, term_counts
from forumlens.session import stage

# Digits of a score or of log-odds that count: beyond them, engines that add in another order differ.
SCORE_DIGITS = 9


def class_sizes(docs: DataFrame, label: str = "label") -> dict:
    """Rows per class, in order of the classes; the classes are a label's fixed set of values, not a key column."""
    counts = docs.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return dict(sorted((r[label], r["n"]) for r in counts.collect()))


def each_class(classes: list) -> Column:
    return F.explode(F.array(*[F.lit(c) for c in classes]))


@dataclass(frozen=True)
class NaiveBayesModel:
    """Everything scoring needs; ``priors`` are logs, in the order of ``classes``."""

    terms: DataFrame
    classes: list
    priors: list[float]

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame(list(zip(self.classes, self.priors)), ["class", "prior"]).coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NaiveBayesModel:
        classes = sorted(map(tuple, spark.read.parquet(f"{path}/classes").collect()))
        return cls(spark.read.parquet(f"{path}/terms"), [c for c, _ in classes], [p for _, p in classes])

    def log_probabilities(self) -> DataFrame:
        """The model in rows (label, prior, term, idf, logp)."""
        per_class = [F.struct(F.lit(c).alias("label"), F.lit(p).alias("prior"), F.col("logp")[i].alias("logp"))
                     for i, (c, p) in enumerate(zip(self.classes, self.priors))]
        return self.terms.select("term", "idf", F.inline(F.array(*per_class)))


def fit(docs: DataFrame, rule: VocabularyRule = VocabularyRule(), alpha: float = 1.0) -> NaiveBayesModel:
    """Fit on rows (id, label, terms), stored or staged: vocabulary, idf and word probabilities from these rows only.

    Weights are summed per class and term inside blocks of posts. The vocabulary and the sums are staged, so later joins meet a plain table of known size. What
    reaches the driver are two numbers per class.
    """
    sizes = class_sizes(docs)
    classes = list(sizes)
    postings = term_counts(docs, keep=("id", "label"))
    vocabulary = stage(fit_vocabulary(postings, corpus_size(docs), rule).select("term", "idf"))
    n = len(classes)

    # a function of its own, so that executors need not have this package
    def sums_of_block(posts: pa.Table, known: pa.Table, post: np.ndarray, place: np.ndarray) -> pa.Table:
        ids = posts["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        labels = posts["label"].combine_chunks()
        own = pc.fill_null(pc.index_in(labels, value_set=pa.array(classes, labels.type)), n).to_numpy(zero_copy_only=False)
        size = max(len(known), 1)
        entry, tf = np.unique((ids * (n + 1) + own)[post] * size + place, return_counts=True)
        term, name, cls = entry % size, entry // size // (n + 1), entry // size % (n + 1)
        x = tf * known["idf"].to_numpy()[term]
        w = x / np.sqrt(np.bincount(name, weights=x * x))[name] if len(x) else x
        return pa.table({"term": known["term"], **{f"w{i}": np.bincount(term[cls == i], weights=w[cls == i], minlength=len(known)) for i in range(n)}})

    schema = ", ".join(["term string", *(f"w{i} double" for i in range(n))])
    in_block = in_blocks(docs, vocabulary, sums_of_block, schema, keep=("id", "label"))
    sums = stage(in_block.groupBy("term").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(n))).join(vocabulary, "term"))
    totals = sums.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(classes))]).first()
    logp = [F.log((F.col(f"w{i}") + alpha) / ((totals[f"w{i}"] or 0.0) + alpha * totals["n"]))
            for i in range(len(classes))]
    known = sum(sizes.values())
    return NaiveBayesModel(sums.select("term", "idf", F.array(*logp).alias("logp")), classes,
                           [math.log(sizes[c] / known) for c in classes])


def _class_scores(docs: DataFrame, model: NaiveBayesModel) -> DataFrame:
    """Log-likelihood plus prior of every class per post (id, scores). ``docs`` are stored or staged.

    The sum of each class and the post's length are made in blocks of posts. A post without a known term, or without an id, keeps the priors;
    rows with one id are scored together.
    """
    priors = np.array(model.priors, float)

    # a function of its own, so that executors need not have this package
    def scores(posts: pa.Table, known: pa.Table, post: np.ndarray, place: np.ndarray) -> pa.Table:
        names = posts["id"].combine_chunks()
        ids = names.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        n = max(len(known), 1)
        entry, tf = np.unique(ids[post] * n + place, return_counts=True)
        own, term = entry // n, entry % n
        x, rows = tf * known["idf"].to_numpy()[term], int(ids.max(initial=-1)) + 1
        length = np.sqrt(np.bincount(own, weights=x * x, minlength=rows))
        logp = known["logp"].combine_chunks().flatten().to_numpy().reshape(len(known), len(priors))
        sums = np.stack([np.bincount(own, weights=x * logp[term, i], minlength=rows) for i in range(len(priors))], axis=1)
        sums = np.divide(sums, length[:, None], out=np.zeros_like(sums), where=length[:, None] > 0)[ids]
        sums[names.is_null().to_numpy(zero_copy_only=False)] = 0.0
        return pa.table({"id": names, "scores": pa.array(list(sums + priors), pa.list_(pa.float64()))})

    kind = docs.schema["id"].dataType.simpleString()
    return in_blocks(docs, model.terms.select("term", "idf", "logp"), scores, f"id {kind}, scores array<double>")


def joint_scores(docs: DataFrame, model: NaiveBayesModel) -> DataFrame:
    """Score of each class per post in rows (id, class, score)."""
    return _in_rows(_class_scores(docs, model), model, "scores", "score")


def _in_rows(df: DataFrame, model: NaiveBayesModel, column: str, name: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("class"), F.col(column)[i].alias(name)) for i, c in enumerate(model.classes)]
    return df.select("id", F.inline(F.array(*pairs)))


def predict_proba(docs: DataFrame, model: NaiveBayesModel) -> DataFrame:
    """Probability of each class per post and its log-odds against the others (id, class, proba, odds).

    Log-odds tell posts apart whose probabilities are too close to 0 or 1 to differ; they are infinite for a single class.
    """
    best_first = F.sort_array("scores", asc=False)
    others = F.slice(best_first, 2, max(len(model.classes) - 1, 1))
    scored = _class_scores(docs, model).select("id", "scores", F.array_max("scores").alias("top"), others.alias("others"))
    scored = scored.withColumn("rest", _log_sum(F.col("others"), F.col("others")[0])).withColumn(
        "total", F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))))

    def odds(s: Column) -> Column:
        # the sum without the best class is taken as such, as a difference from the total would lose all digits
        beside = F.when(s == F.col("top"), F.coalesce("rest", F.lit(-math.inf))).otherwise(
            F.col("top") + F.log(F.col("total") - F.exp(s - F.col("top"))))
        return s - beside

    both = scored.select("id", F.transform("scores", lambda s: F.struct(
        (F.exp(s - F.col("top")) / F.col("total")).alias("proba"), F.round(odds(s), SCORE_DIGITS).alias("odds"))).alias("both"))
    return _in_rows(both, model, "both", "both").select("id", "class", "both.proba", "both.odds")


def _log_sum(scores: Column, top: Column) -> Column:
    """Log of the sum of exponentials of scores of which ``top`` is the largest."""
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top)))


def predict(docs: DataFrame, model: NaiveBayesModel) -> DataFrame:
    """The most probable class per post (id, prediction); the first in order on a tie."""
    rounded = _class_scores(docs, model).select(
        "id", F.transform("scores", lambda s: F.round(s, SCORE_DIGITS)).alias("scores"))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return rounded.select("id", F.element_at(F.array(*[F.lit(c) for c in model.classes]), best).alias("prediction"))
