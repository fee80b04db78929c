"""The generated tables read as a table of forum posts.

Each document is a post; the event with the same number gives its author, time, score and
comment count; a labelled document carries a tag. Ids stay numeric, as in the tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files are taken into a batch until they have so many bytes.
BATCH_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_number(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def seconds_since_epoch(naive_time: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", _epoch(), naive_time)


def utc_time(seconds: Column) -> Column:
    """The timestamp without zone that many seconds after 1970."""
    return F.timestamp_add("SECOND", seconds, _epoch())


def posts(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """The post table; ``documents`` may be a stream of the documents instead of the table.

    By definition of this view a post's author, time and counters are those of the one event with its number; other
    events belong to no post. Texts with the same letters share a url.
    """
    documents = (table(spark, sf_dir, "documents") if documents is None else documents).alias("d")
    events = table(spark, sf_dir, "events").alias("e")
    labels = table(spark, sf_dir, "labels").alias("l")
    return (
        documents
        .join(events, F.col("e.event_id") == F.col("d.doc_id"))
        .join(labels, F.col("l.doc_id") == F.col("d.doc_id"), "left")
        .select(
            F.col("d.doc_id").alias("id"),
            F.col("e.user_id").alias("author"),
            F.col("d.text").alias("title"),
            F.floor("e.value").cast("bigint").alias("score"),
            F.concat(F.lit("/p/"), F.md5(F.regexp_replace(F.lower("d.text"), r"[^\p{L}]+", ""))).alias("url"),
            event_number("e.props").alias("num_comments"),
            F.col("d.source").alias("subreddit"),
            seconds_since_epoch(F.col("e.ts")).alias("created_utc"),
            F.col("e.ts").alias("created_time"),
            F.when(F.col("l.doc_id").isNotNull(), F.col("e.event_type")).alias("link_flair_text"),
            F.col("d.lang").alias("lang"),
            F.col("l.quality").alias("quality"),
        )
    )


def with_bodies(posts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the text of the first turn of the conversation of their number as their own text (``selftext``)."""
    turns = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    first = turns.groupBy(F.col("conv_id").alias("_id")).agg(F.min("text").alias("selftext"))
    return posts.join(first, F.col("id") == F.col("_id"), "left").drop("_id")


def posts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as they arrive: the documents as a file stream, joined to the other two tables.

    The table may be one file or a folder of them.
    """
    schema = table(spark, sf_dir, "documents").schema
    arriving = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{sf_dir}/documents*.parquet")
    return posts(spark, sf_dir, arriving)
