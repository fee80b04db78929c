"""Catalog checks and typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forumlens.sources.schema import STORED_POST


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_post_table(spark: SparkSession, name: str, buckets: int | None = None) -> None:
    """Create an empty post table if there is none.

    With ``buckets`` the table is bucketed by id, so key joins need not shuffle it. The key's
    uniqueness is kept by ``operators.ingest.insert_if_absent``.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED_POST.fields)
    layout = f" CLUSTERED BY (id) INTO {int(buckets)} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{layout}")


def require_database(spark: SparkSession, name: str) -> None:
    if not spark.catalog.databaseExists(name):
        raise LookupError(f"database {name} does not exist")


def require_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise LookupError(f"table {name} does not exist")
    return spark.table(name)


def column_types(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns, in order."""
    return [(f.name, f.dataType.simpleString()) for f in require_table(spark, name).schema.fields]


def replace_staging(batch: DataFrame, name: str) -> None:
    """Empty the staging table and load one batch into it."""
    batch.write.mode("overwrite").format("parquet").saveAsTable(name)
