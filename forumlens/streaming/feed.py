"""The live feed: search, duplicate-free ingest and scoring of posts as they arrive.

Every writer handles what is available and then stops; a caller who wants it to go on passes
another trigger. State and progress live under a checkpoint folder all executors can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forumlens.operators.bayes import NaiveBayesModel, predict
from forumlens.operators.ingest import insert_if_absent
from forumlens.session import stage
from forumlens.sources.search import SearchSpec, live_view, matching_posts

AVAILABLE_NOW = {"availableNow": True}


def live_search(stream: DataFrame, spec: SearchSpec) -> DataFrame:
    """Arriving posts that match, in the live projection; no state, and no limit on a stream."""
    return live_view(matching_posts(stream, spec))


def first_seen(stream: DataFrame, delay: str, key: str = "id", event_time: str = "created_time") -> DataFrame:
    """Drop repeats of a key that arrive within ``delay``; state older than that is discarded.

    A time without zone is taken as UTC, since a watermark needs a full timestamp.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def write_feed(stream: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Append the stream to parquet files, each row exactly once."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def ingest_feed(stream: DataFrame, table: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Insert arriving posts that the table does not hold yet.

    The check against the stored keys makes a repeated batch add nothing, so a restart after a
    lost executor or driver leaves each post in the table once.
    """
    def insert(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, table, tolerate_duplicates=True)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def score_feed(stream: DataFrame, model: NaiveBayesModel, path: str, checkpoint: str,
               trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Predict the class of arriving posts (id, terms) with a stored model.

    Each batch has its own folder, which a repeated batch overwrites.
    """
    def score(batch: DataFrame, number: int) -> None:
        predict(stage(batch), model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**trigger).start()
