"""A stored post table laid out by day and channel, so that a search reads only the folders it needs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.sources.search import SearchSpec, filter_channel, search_posts

SECONDS_PER_DAY = 86_400


def day_of(seconds: str = "created_utc") -> Column:
    """Days since 1970 of a time in seconds, as a date."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(seconds) / SECONDS_PER_DAY).cast("int"))


def write_posts(posts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write posts into folders by day (UTC) and channel; each folder is written by one task, large ones by several.

    A folder that would be large is split by adaptive execution, since the rows are only rebalanced and not dealt by key alone.
    """
    dated = posts.withColumn("day", day_of())
    dated.hint("rebalance", "day", "subreddit").write.mode(mode).partitionBy("day", "subreddit").parquet(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """The stored posts with their day; channels stay strings even if all look like numbers."""
    with_types = spark.read.option("basePath", path).parquet(path)
    return with_types.withColumn("subreddit", F.col("subreddit").cast("string"))


def search_stored(posts: DataFrame, spec: SearchSpec) -> DataFrame:
    """``search_posts`` over a stored table: the bounds of time also bound the days, so other days are not listed as input."""
    if spec.after is not None:
        posts = posts.where(F.col("day") >= F.lit(_date(spec.after)).cast("date"))
    if spec.before is not None:
        posts = posts.where(F.col("day") <= F.lit(_date(spec.before)).cast("date"))
    return search_posts(filter_channel(posts, spec.subreddit), spec)


def _date(seconds: int) -> str:
    return (dt.date(1970, 1, 1) + dt.timedelta(days=seconds // SECONDS_PER_DAY)).isoformat()


def on_days(posts: DataFrame, days: DataFrame) -> DataFrame:
    """Posts of the days in a table (day); where it is small its days prune the folders while the query runs."""
    return posts.join(days.select("day").distinct(), "day", "left_semi")
