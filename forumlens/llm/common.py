"""What the operators of this package share: bounded Arrow batches, document keys, files in the shared folder."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.session import shared_dir

BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@cache
def _shipped(application: str) -> list[str]:
    return []


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application; functions are named there, not copied."""
    sent = _shipped(spark.sparkContext.applicationId)
    if sent:
        return
    root = Path(__file__).parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    address = f"{new_folder(spark, 'package')}.zip"
    system, path = store(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    write_file(address, [packed.getvalue()])
    spark.sparkContext.addPyFile(address)
    sent.append(address)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` whose batches are bounded in bytes, so that very long texts do not fill a worker."""
    spark = df.sparkSession
    ship_package(spark)
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if not 0 < bound <= BATCH_BYTES:  # stays as it is from now on, since plans are made later
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) of any table that has them; other columns, whatever their names, are left behind."""
    return df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; null and the empty text are the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def record_batch(**columns) -> pa.RecordBatch:
    return pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def new_folder(spark: SparkSession, purpose: str) -> str:
    """The address of a folder of its own below the shared one."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def store(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it; a bare path is local."""
    if "://" not in address and not address.startswith("file:"):
        return pafs.LocalFileSystem(), address
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(address)


def write_file(address: str, parts: list[bytes | np.ndarray]) -> None:
    system, path = store(address)
    with system.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def map_file(address: str) -> memoryview:
    """A file's bytes: memory-mapped where the store is mounted, read at once elsewhere."""
    system, path = store(address)
    if isinstance(system, pafs.LocalFileSystem):
        if system.get_file_info(path).size == 0:
            return memoryview(b"")
        return memoryview(pa.memory_map(path).read_buffer())
    with system.open_input_file(path) as file:
        return memoryview(file.read_buffer())
