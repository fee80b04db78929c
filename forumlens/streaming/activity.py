"""What is being discussed now: posts, comments and best score per tag and window of event time, kept up as posts arrive.

Two results of one aggregation. The log of closed windows (append mode) gets each window once, when the watermark, the latest time seen
less an allowed delay, has passed its end; a post that arrives when its window is closed is dropped and counted. The current
table (complete mode) has all windows, open ones too, after every batch, and late posts still count in it; its state holds all windows. State, progress and
the watermark live under the checkpoint folder, so a run that was ended goes on where it stopped and writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forumlens.streaming.feed import AVAILABLE_NOW, write_feed

SPAN = "1 hour"
DELAY = "30 minutes"


def activity(posts: DataFrame, span: str = SPAN, delay: str = DELAY, tag: str = "link_flair_text",
             event_time: str = "created_time") -> DataFrame:
    """(window_start, window_end, tag, n_posts, n_comments, top_score) of a stream or a table of posts.

    A time without zone is taken as UTC, since a watermark needs a full timestamp; posts without a time are in no window, and
    posts without a tag share the tag NULL.
    """
    timed = posts.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", delay)
    counted = timed.groupBy(F.window("_at", span).alias("window"), F.col(tag).alias("tag")).agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum("num_comments").alias("n_comments"), F.max("score").alias("top_score"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tag",
                          "n_posts", "n_comments", "top_score")


def write_closed(windows: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Append every window to parquet files once it is closed, each exactly once."""
    return write_feed(windows, path, checkpoint, trigger)


def write_current(windows: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Write the table of all windows after every batch, to a folder of the batch, which a repeated batch overwrites."""
    def put(table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (windows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the latest batch; only the folder of that batch is read."""
    batches = spark.read.parquet(path)
    latest = batches.agg(F.max("batch")).scalar()
    return batches.where(F.col("batch") == latest).drop("batch")


def late_posts(query: StreamingQuery) -> int:
    """Posts that a run dropped because their window was closed, as far back as the session keeps progress reports.

    ``spark.sql.streaming.numRecentProgressUpdates`` sets how many reports those are. Rows are counted after partial aggregation, so late posts
    of one tag and window in one task count once.
    """
    return sum(int(state["numRowsDroppedByWatermark"]) for report in query.recentProgress for state in report["stateOperators"])


def most_active(windows: DataFrame, at: Column, n: int = 3) -> DataFrame:
    """The n tags with most comments in the window that holds a time, best first."""
    held = windows.where((F.col("window_start") <= at) & (at < F.col("window_end")))
    return held.orderBy(F.desc("n_comments"), F.desc("n_posts"), "tag").limit(n)
