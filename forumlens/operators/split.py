"""Balanced, reproducible splits: every label is divided in the same proportion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.operators.ordering import hash_rank


def stratified_split(rows: DataFrame, label: str, key: str = "id", test_share: float = 0.3,
                     seed: int = 0) -> DataFrame:
    """Add ``split``: the first ``round(test_share * size)`` of each label by hash are 'test'."""
    ranked = hash_rank(rows, label, key, seed)
    quota = F.floor(F.col("group_size") * F.lit(test_share) + F.lit(0.5))
    return ranked.withColumn("split", F.when(F.col("pos") < quota, "test").otherwise("train")).drop("pos", "group_size")


def stratified_folds(rows: DataFrame, label: str, key: str = "id", n_folds: int = 3, seed: int = 0) -> DataFrame:
    """Add ``fold``: within a label, fold sizes differ by at most one."""
    ranked = hash_rank(rows, label, key, seed)
    return ranked.withColumn("fold", (F.col("pos") % n_folds).cast("int")).drop("pos", "group_size")
