"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "forumlens", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: submit-time settings
    decide both, and adaptive execution merges small and splits skewed partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # one process does all the work
            builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a folder beside the tables of the warehouse, which executors share too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/forumlens-staging"


def _staging_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, purpose: str) -> str:
    """A path of its own below the shared folder; ``drop_staged`` deletes what is written there."""
    return f"{_staging_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    Used where several later steps read one expensive result. The lineage ends at the files,
    so a lost executor costs a re-read, and the optimiser sees real sizes and prunes columns.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_whole(df))


def stage_whole(df: DataFrame) -> str:
    """Write ``df`` to the shared folder; the address, for ``part_reader``."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return path


def stage_parts(df: DataFrame, by: str) -> str:
    """Write ``df`` to the shared folder, the rows of each value of a column apart; the address, for ``part_reader``."""
    path = new_path(df.sparkSession, "parts")
    df.write.partitionBy(by).parquet(path)
    return path


def part_reader(rows: int = 1 << 13) -> Callable[[str], Iterator[pa.RecordBatch]]:
    """What reads a folder of the shared one inside a task, batch by batch, so that it need not move for every task that needs it; a folder that is not
    there has no rows. A function of its own, so that executors need not have this package."""
    def read(address: str) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        import pyarrow.parquet as pq
        from pyarrow import fs

        if address.startswith("file:"):
            system, path = fs.LocalFileSystem(), "/" + unquote(address[len("file:"):]).lstrip("/")
        else:
            system, path = fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)
        for found in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
            if found.path.endswith(".parquet"):
                with system.open_input_file(found.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(rows)

    return read


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; call it when no result is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_staging_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
