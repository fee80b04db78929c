"""CSV files of search results: one with a header per search, headerless ones for staging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.sources.schema import POST_ATTRIBUTES, SEARCH_RESULT
from forumlens.sources.search import typed_result

# How a result file is stamped and how times are written in it.
STAMP_FORMAT = "%Y_%m_%d-%H_%M_%S"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
_DIALECT = {"quote": '"', "escape": '"', "multiLine": "true", "timestampFormat": TIME_FORMAT}


def write_result(posts: DataFrame, out_dir: str, now: dt.datetime | None = None) -> str:
    """Write a search result with a header under a time-stamped folder; returns its path."""
    path = f"{out_dir.rstrip('/')}/search_{(now or dt.datetime.now()).strftime(STAMP_FORMAT)}.csv"
    posts.write.csv(path, header=True, quote='"', escape='"', timestampFormat=TIME_FORMAT)
    return path


def write_staging(posts: DataFrame, path: str) -> None:
    """Replace the headerless staging file; columns in the order of a search result."""
    posts.select(*SEARCH_RESULT.names).write.mode("overwrite").csv(
        path, header=False, quote='"', escape='"', timestampFormat=TIME_FORMAT)


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Typed load of a staging file; the ingest time is filled in with the load time."""
    rows = spark.read.schema(SEARCH_RESULT).options(**_DIALECT).csv(path, header=False)
    return rows.withColumn("updated_time", F.current_timestamp())


def _conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read result files whose headers may order or omit columns differently.

    Spark takes one header for all files of a scan, so each file is its own scan; a column a
    file does not have is NULL. A blank field reads as NULL, as it does for the writer.
    """
    if not paths:
        raise ValueError("no result files given")
    frames = [
        _conform(spark.read.options(**_DIALECT).csv(p, header=True, enforceSchema=False), SEARCH_RESULT)
        for p in paths
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """Raw search output, one JSON object per post; an attribute that an object lacks is NULL."""
    return typed_result(spark.read.schema(POST_ATTRIBUTES).json(path))
