"""Keyed writes: insert posts that are new, keep the latest version of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.operators.clean import keep_first, newest_first, repeated_keys


class DuplicateKeys(ValueError):
    """A batch holds a key more than once."""


def require_unique(batch: DataFrame, key: str = "id") -> None:
    sample = repeated_keys(batch, key).limit(3).collect()
    if sample:
        raise DuplicateKeys(f"{key} occurs more than once: {[r[0] for r in sample]}")


def absent_rows(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet.

    The stored keys are first reduced to those in the batch. When the batch is small the
    optimiser broadcasts it there, so the large stored table is scanned but never shuffled.
    """
    known = stored.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(known, key, "left_anti")


def merged(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The stored table after the insert: the first-seen row of a key wins."""
    return stored.unionByName(absent_rows(stored, batch, key), allowMissingColumns=True)


def insert_if_absent(batch: DataFrame, table: str, key: str = "id", tolerate_duplicates: bool = False) -> None:
    """Append the new posts of a batch to a table, stamped with the time of ingest.

    Repeating the call adds nothing. A key repeated within the batch is an error unless
    ``tolerate_duplicates`` asks for the newest of its rows.
    """
    spark = batch.sparkSession
    if tolerate_duplicates:
        batch = keep_first(batch, key, newest_first(id_column=key))
    else:
        require_unique(batch, key)
    stored = spark.table(table)
    stamped = batch.withColumn("updated_time", F.current_timestamp())
    absent_rows(stored, stamped, key).select(*stored.columns).write.insertInto(table)


def latest_by_key(versions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last version of each document replaces all earlier ones as a whole."""
    payload = F.struct(*[F.col(c) for c in versions.columns if c != key])
    return versions.groupBy(key).agg(F.max_by(payload, F.struct(*order)).alias("_doc")).select(key, "_doc.*")
