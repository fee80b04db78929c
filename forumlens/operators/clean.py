"""Tag handling and duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what an absent tag is replaced by.
MISSING_TAG = "Tag Missing"


def exclude_tag(posts: DataFrame, tag: str, column: str = "link_flair_text") -> DataFrame:
    """Drop posts with the tag; posts without any tag stay."""
    return posts.where(~F.col(column).eqNullSafe(tag))


def fill_missing_tag(posts: DataFrame, column: str = "link_flair_text") -> DataFrame:
    return posts.fillna({column: MISSING_TAG})


def with_tags(posts: DataFrame, *tags: str, column: str = "link_flair_text") -> DataFrame:
    return posts.where(F.col(column).isin(*tags))


def newest_first(id_column: str = "id", time_column: str = "created_utc") -> list[Column]:
    """The order that decides which of several copies is kept; a post without a time comes last."""
    return [F.col(time_column).isNull(), -F.col(time_column), F.col(id_column)]


def keep_first(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; NULL counts as a key.

    An aggregation instead of a window: every task reduces its copies of a key to one row
    before the shuffle, so a key that holds a large share of all rows stays cheap.
    """
    payload = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(payload, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def dedupe_title_then_url(posts: DataFrame) -> DataFrame:
    """Drop repeated titles, then repeated urls among the survivors; the newest post is kept.

    Posts are told apart by ``id``. Only hashes, times and ids are shuffled to find the survivors; a text moves once,
    when the posts are joined with their ids.
    """
    keys = posts.select("id", "created_utc", F.sha2("title", 256).alias("title"), F.sha2("url", 256).alias("url"))
    order = F.struct(*newest_first())
    value = F.struct("id", "created_utc", "url")
    titles = keys.groupBy("title").agg(F.min_by(value, order).alias("p")).select("p.*")
    kept = titles.groupBy("url").agg(F.min_by("id", order).alias("id")).select("id")
    return posts.join(kept, "id", "left_semi")


def duplicate_counts(posts: DataFrame, keys: tuple[str, ...] = ("title", "url")) -> DataFrame:
    """Rows beyond the first per key, for each key column; NULL counts as one key."""
    excess = [
        (F.count(F.lit(1)) - F.countDistinct(k) - F.coalesce(F.max(F.col(k).isNull().cast("bigint")), F.lit(0)))
        .cast("bigint").alias(f"dup_{k}")
        for k in keys
    ]
    return posts.agg(*excess)


def repeated_keys(rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once, with their number of rows; empty for a valid batch."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def drop_columns_like(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.select(*[c for c in rows.columns if pattern not in c])
