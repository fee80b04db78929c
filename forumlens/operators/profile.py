"""Counts, shares, reshaping and other descriptions of a post table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions.text import word_count

TAG = "link_flair_text"


def _known(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups are formed over known keys only: rows with a NULL key belong to none."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def count_by(posts: DataFrame, *keys: str) -> DataFrame:
    return _known(posts, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"))


def share_by(posts: DataFrame, key: str = TAG) -> DataFrame:
    """Percentage of all posts per key; untagged posts count in the whole but form no group."""
    per_key = posts.groupBy(key).agg(F.count(F.lit(1)).alias("n_posts"))
    total = posts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _known(per_key, key).select(key, (F.col("n_posts") / total * 100).alias("share_pct"))


def comments_by_tag_wide(posts: DataFrame, tags: tuple[str, ...], tag_column: str = TAG) -> DataFrame:
    """Posts per comment count, one column per tag, 0 where there is none."""
    tagged = _known(posts, "num_comments").where(F.col(tag_column).isin(*tags))
    return tagged.groupBy("num_comments").agg(*[
        F.count_if(F.col(tag_column) == t).alias(t) for t in tags
    ])


def comments_by_tag_long(wide: DataFrame, tags: tuple[str, ...], tag_column: str = TAG) -> DataFrame:
    """The wide table back in rows; cells of 0 are kept."""
    return wide.unpivot("num_comments", list(tags), tag_column, "n_posts")


def distinct_with_null(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Number of distinct values, where NULL is a value."""
    null_seen = F.coalesce(F.max(F.col(column).isNull().cast("bigint")), F.lit(0))
    return rows.agg((F.countDistinct(column) + null_seen).cast("bigint").alias(name))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def avg_words_by(posts: DataFrame, words: Column, key: str = TAG) -> DataFrame:
    return _known(posts, key).groupBy(key).agg(F.avg(words).alias("avg_words"))


def avg_title_words(posts: DataFrame) -> DataFrame:
    return posts.agg(F.avg(word_count(F.col("title"))).alias("avg_words"))


def avg_posts_per_author_tag(posts: DataFrame, tag_column: str = TAG) -> DataFrame:
    """Mean size of the (author, tag) groups."""
    return count_by(posts, "author", tag_column).agg(F.avg("n_posts").alias("avg_posts"))


def authors_of_both_tags(posts: DataFrame, tag1: str, tag2: str, tag_column: str = TAG) -> DataFrame:
    """Authors with posts under both tags and how many under each: one aggregation, no self-join."""
    per_author = (
        _known(posts, "author").where(F.col(tag_column).isin(tag1, tag2))
        .groupBy("author").agg(
            F.count_if(F.col(tag_column) == tag1).alias("n_posts_tag1"),
            F.count_if(F.col(tag_column) == tag2).alias("n_posts_tag2"),
        )
    )
    return per_author.where((F.col("n_posts_tag1") > 0) & (F.col("n_posts_tag2") > 0))


def most_active(both: DataFrame, n: int = 5) -> DataFrame:
    return both.orderBy(F.desc("n_posts_tag1"), F.desc("n_posts_tag2"), "author").limit(n)


def table_profile(rows: DataFrame) -> DataFrame:
    """Per column: its type, the number of rows and of non-null values, in one pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in rows.columns])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    long = counts.unpivot("_rows", rows.columns, "column_name", "non_null")
    kind = F.lit(None).cast("string")
    for name, type_name in types.items():
        kind = F.when(F.col("column_name") == name, type_name).otherwise(kind)
    return long.select("column_name", kind.alias("column_type"), F.col("_rows").alias("n_rows"), "non_null")


def mode_of_tag(posts: DataFrame, matches: Column, tag_column: str = TAG) -> DataFrame:
    """The most frequent tag among matching posts; the first in order on a tie."""
    return count_by(posts.where(matches), tag_column).orderBy(F.desc("n_posts"), tag_column).limit(1)


def thread_stats(turns: DataFrame) -> DataFrame:
    """Comments of each thread given as rows: turn 0 is the post, later turns are its comments.

    The first comment is found by an aggregate, so a thread of any length is never gathered.
    """
    is_comment = F.col("turn") > 0
    return turns.groupBy("conv_id").agg(
        F.count_if(is_comment).alias("n_comments"),
        F.min_by(F.when(is_comment, F.col("text")), F.when(is_comment, F.col("turn"))).alias("first_comment"),
    )


def nested_thread_stats(threads: DataFrame) -> DataFrame:
    """The same for posts that arrive with their comments nested."""
    return threads.select(
        "id",
        F.coalesce(F.size("comments"), F.lit(0)).cast("bigint").alias("n_comments"),
        F.try_element_at("comments", F.lit(1))["body"].alias("first_comment"),
    )
