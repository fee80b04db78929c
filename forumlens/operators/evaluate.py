"""Quality of predictions: accuracy, per-class report, confusion matrix, ROC curve and its area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.operators.bayes import each_class
from forumlens.operators.ordering import running_totals


def accuracy(predicted: DataFrame) -> DataFrame:
    """Share of rows (label, prediction) that agree."""
    return predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion_matrix(predicted: DataFrame, classes: list) -> DataFrame:
    """Rows per (label, prediction), with a row for every combination of the classes."""
    counts = predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return _all_cells(counts, classes)


def _all_cells(counts: DataFrame, classes: list) -> DataFrame:
    spark = counts.sparkSession
    cells = spark.range(1).select(each_class(classes).alias("label")).select(
        "label", each_class(classes).alias("prediction"))
    return cells.join(counts, ["label", "prediction"], "left").fillna({"n": 0})


def classification_report(predicted: DataFrame, classes: list) -> DataFrame:
    """Precision, recall, f1 and support per class, and their macro and weighted means.

    Everything after the first count works on classes squared many rows.
    """
    cells = confusion_matrix(predicted, classes)
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col("label").alias("name")).agg(hit.alias("hits"), F.sum("n").alias("support"))
    claimed = cells.groupBy(F.col("prediction").alias("name")).agg(F.sum("n").alias("claimed"))

    def ratio(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    per_class = (
        actual.join(claimed, "name")
        .withColumn("precision", ratio(F.col("hits"), F.col("claimed")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select(F.col("name").cast("string").alias("name"), "precision", "recall", "f1", "support")
    )
    measures = ("precision", "recall", "f1")
    macro = per_class.agg(F.lit("macro avg").alias("name"), *[F.avg(m).alias(m) for m in measures],
                          F.sum("support").alias("support"))
    weighted = per_class.agg(
        F.lit("weighted avg").alias("name"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"))
    return per_class.unionByName(macro).unionByName(weighted)


def score_counts(scores: DataFrame, labels: DataFrame, by: str = "proba") -> DataFrame:
    """Positives and negatives per class and distinct score ``by``, one class against the rest."""
    joined = scores.join(labels.select("id", "label"), "id")
    positive = F.col("label") == F.col("class")
    return joined.groupBy("class", by).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_points(counts: DataFrame, group: tuple[str, ...] = ("class",), by: str = "proba") -> DataFrame:
    """The curve: false and true positive rate at every distinct threshold, from (0, 0) on.

    The starting point has an infinite threshold. A class without positives or negatives has
    undefined (NULL) rates on that axis.
    """
    totals = running_totals(counts, list(group), by, {"pos": "pos", "neg": "neg"})
    points = totals.select(
        *group, F.col(by).alias("threshold"),
        F.try_divide("cum_neg", "all_neg").alias("fpr"), F.try_divide("cum_pos", "all_pos").alias("tpr"))
    start = counts.select(*group).distinct().select(
        *group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(counts: DataFrame, group: tuple[str, ...] = ("class",), by: str = "proba") -> DataFrame:
    """Area under the curve per group: each negative counts the positives scored above it, ties half.

    Equals the trapezoid area over all distinct thresholds; NULL without positives or negatives.
    """
    totals = running_totals(counts, list(group), by, {"pos": "pos", "neg": "neg"})
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return totals.groupBy(*group).agg(
        F.try_divide(area, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc"))
