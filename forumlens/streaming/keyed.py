"""A table of the latest version of every document, kept up by a stream: a later version replaces the whole document.

Keys are dealt into a fixed number of buckets, which are the partitions of the table. A batch reads and rewrites only the buckets its
keys fall into; the files of all others stay. The rewritten buckets are first written beside the checkpoint and then
put in place, so a batch that is repeated after a loss in between puts the same rows in place again. An older version never
replaces a later one, so repeated and late batches do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forumlens.operators.ingest import latest_by_key
from forumlens.streaming.feed import AVAILABLE_NOW

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    address = spark._jvm.org.apache.hadoop.fs.Path(path)
    return address.getFileSystem(spark._jsc.hadoopConfiguration()).exists(address)


def _delete(spark: SparkSession, path: str) -> None:
    address = spark._jvm.org.apache.hadoop.fs.Path(path)
    address.getFileSystem(spark._jsc.hadoopConfiguration()).delete(address, True)


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put_latest(batch: DataFrame, path: str, pending: str, key: str, order: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """Merge the documents of a batch into the table at ``path``; rows without a key are left out.

    ``order`` are the columns that tell which version is later. The buckets touched, at most ``buckets`` numbers, come to the driver, so that
    only their folders are read.
    """
    spark = batch.sparkSession
    if not _exists(spark, f"{pending}/_SUCCESS"):
        versions = [F.col(c) for c in order]
        new = latest_by_key(batch.where(F.col(key).isNotNull()), key, versions).withColumn("bucket", bucket_of(key, buckets))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        if _exists(spark, path):
            stored = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
            new = latest_by_key(stored.select(*batch.columns).unionByName(new.select(*batch.columns)), key, versions).withColumn(
                "bucket", bucket_of(key, buckets))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(pending)
    merged = spark.read.parquet(pending)
    merged.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def write_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: tuple[str, ...], buckets: int = BUCKETS,
                 trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Keep the table at ``path`` at the latest version of each document of the stream."""
    def put(batch: DataFrame, number: int) -> None:
        put_latest(batch, path, f"{checkpoint}-pending/batch={number}", key, order, buckets)
        _delete(batch.sparkSession, f"{checkpoint}-pending/batch={number - 1}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
