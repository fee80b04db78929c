"""How a text spreads over channels: each post is joined to the latest earlier post of the same url in another channel.

An as-of join by windows over (url, time bucket). Posts of one channel in a row form a run; the post before the run
is what every post of the run came from. A bucket's first run may have begun in an earlier bucket, so each bucket
hands on its last post and the last one in another channel than that; what they lead to for the whole
history of a url is found on these few rows alone. A url that everybody posts is spread over as many tasks as it has buckets, and no
post is ever joined to more than one other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import stage

BUCKET_SECONDS = 6 * 3600


def _with_source(posts: DataFrame, *by: str) -> DataFrame:
    """The post before the run of one channel that each row belongs to, as ``source``; NULL in the first run of a group."""
    order = Window.partitionBy(*by).orderBy("post.at", "post.id")
    begins = posts.withColumn("_previous", F.lag("post").over(order)).withColumn(
        "_begins", F.when(F.col("_previous.channel") != F.col("post.channel"), F.col("_previous")))
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return begins.withColumn("source", F.last("_begins", ignorenulls=True).over(to_here)).drop("_previous", "_begins")


def _differs(post: Column, channel: Column) -> Column:
    return F.when(post["channel"] != channel, post)


def hops(posts: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(id, channel, at, from_id, from_channel, from_at) of posts (id, url, channel, at) that have a source.

    ``at`` is a number of seconds; earlier is by time, then id. Posts without url, channel, time or id take no part.
    """
    whole = posts.select("id", "url", "channel", "at").na.drop()
    placed = stage(whole.select("url", F.floor(F.col("at") / bucket_seconds).alias("bucket"), F.struct("at", "id", "channel").alias("post")))
    post = F.col("post")
    near = _with_source(placed, "url", "bucket")
    # the last post of each bucket and the last in another channel, as aggregates that shrink inside the tasks
    last = stage(near.groupBy("url", "bucket").agg(F.max(F.struct("post", "source")).alias("x")).select("url", "bucket", "x.post", "x.source"))
    few = last.select("url", "bucket", F.explode(F.filter(F.array("source", "post"), lambda p: p.isNotNull())).alias("post"),
                      (F.col("post")).alias("end"))
    ends = _with_source(few, "url").where(F.col("post") == F.col("end"))
    by_bucket = Window.partitionBy("url").orderBy("bucket")
    handed = stage(ends.select("url", "bucket", F.lag("post").over(by_bucket).alias("tail"), F.lag("source").over(by_bucket).alias("other"))
                   .where(F.col("tail").isNotNull()))
    joined = near.join(handed, ["url", "bucket"], "left")
    channel = post["channel"]
    source = F.coalesce("source", _differs(F.col("tail"), channel), F.col("other"))
    return joined.withColumn("source", source).where(F.col("source").isNotNull()).select(
        "post.id", "post.channel", "post.at", F.col("source.id").alias("from_id"), F.col("source.channel").alias("from_channel"),
        F.col("source.at").alias("from_at"))


def between_channels(found: DataFrame) -> DataFrame:
    """(from_channel, to_channel, n_hops, total_delay, least_delay, most_delay), delays in seconds."""
    delay = F.col("at") - F.col("from_at")
    return found.groupBy("from_channel", F.col("channel").alias("to_channel")).agg(
        F.count(F.lit(1)).alias("n_hops"), F.sum(delay).alias("total_delay"), F.min(delay).alias("least_delay"), F.max(delay).alias("most_delay"))
