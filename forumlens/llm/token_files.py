"""Token-ID output: flat unsigned integer files with 64-bit document offsets, written and memory-mapped by shard.

A dataset is a folder of shards and a manifest. A shard is three files: ``.bin`` holds the token ids of its documents
one after the other (unsigned 16-bit little-endian, 32-bit where the vocabulary needs it), ``.off`` the n + 1 offsets of
its documents in ids (signed 64-bit, from 0), ``.doc`` the n document numbers (signed 64-bit) and n bytes that are 1 where
the number is null. Shards are ranges of doc_id in ascending order; the manifest gives each its base, the number of ids in
all shards before it, from a prefix sum over the shards' counts. File names are new for each task attempt and count only
once the manifest names them, so a task that is run again, twice or killed leaves a correct dataset.

Null texts are empty (only the end id); null ids come first; rows with equal ids are ordered by a hash of their texts and
are all written; an empty table gives an empty dataset.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.llm.common import documents, map_batches, map_file, new_folder, record_batch, store, text_key, write_file
from forumlens.llm.tokenize import encoder

_SHARD = "shard long, name string, first_id long, n_docs long, n_tokens long"


@dataclass(frozen=True)
class TokenDataset:
    """Where a dataset is, and the width of its ids in bytes."""

    folder: str
    width: int

    def manifest(self, spark: SparkSession) -> DataFrame:
        """(shard, name, first_id, n_docs, n_tokens, base) of every shard that has documents."""
        return spark.read.schema(f"{_SHARD}, base long").parquet(f"{self.folder}/manifest")


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
          shards: int | None = None) -> TokenDataset:
    """Write all documents' ids in ascending doc_id order, each followed by ``end_id``.

    ``shards`` is left to adaptive execution by default. One shuffle by range of doc_id moves each text once.
    """
    spark = docs.sparkSession
    target = folder or new_folder(spark, "tokens")
    dtype = encoder(tokenizer).dtype
    end = np.array([end_id], dtype).tobytes()
    system, path = store(target)
    system.create_dir(f"{path}/shards", recursive=True)

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer).encode_all
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        files, at = store(f"{target}/shards/{name}")
        lengths, numbers, nulls, out = [], [], [], None
        for batch in batches:
            for number, found in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).cast(pa.binary()).to_pylist())):
                if out is None:
                    out = files.open_output_stream(f"{at}.bin")
                ids = found + end
                out.write(ids)
                lengths.append(len(ids) // dtype.itemsize)
                numbers.append(number or 0)
                nulls.append(number is None)
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64)))).astype("<i8")
        write_file(f"{target}/shards/{name}.off", [offsets.tobytes()])
        write_file(f"{target}/shards/{name}.doc", [np.array(numbers, "<i8").tobytes(), np.array(nulls, "u1").tobytes()])
        yield record_batch(shard=[TaskContext.get().partitionId()], name=[name],
                           first_id=pa.array([None if nulls[0] else numbers[0]], pa.int64()),
                           n_docs=[len(lengths)], n_tokens=[int(offsets[-1])])

    rows = documents(docs).withColumn("tie", text_key(F.col("text")))
    by = ("doc_id", "tie")
    dealt = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)
    written = map_batches(dealt.sortWithinPartitions(*by).select("doc_id", "text"), write_shard, _SHARD)
    written.write.parquet(f"{target}/written")  # fixes which attempts count
    counts = spark.read.schema(_SHARD).parquet(f"{target}/written")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    counts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{target}/manifest")
    return TokenDataset(target, dtype.itemsize)


def read(spark: SparkSession, dataset: TokenDataset) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the mapped files.

    ``start`` counts the ids of all documents before it in the dataset; the checksum is taken over the ids widened to
    little-endian unsigned 32-bit integers.
    """
    folder, dtype = dataset.folder, np.dtype(f"<u{dataset.width}")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, base in zip(*(batch.column(c).to_pylist() for c in ("name", "n_docs", "base"))):
                numbers, nulls, offsets, ids = shard(f"{folder}/shards/{name}", n, dtype)
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:])]
                yield record_batch(doc_id=pa.array(numbers, pa.int64(), mask=nulls), start=offsets[:-1] + base,
                                   n_tokens=np.diff(offsets), ids_crc32=pa.array(crc, pa.int64()))

    shards = dataset.manifest(spark)
    dealt = shards.repartition(spark.sparkContext.defaultParallelism, "shard")
    return dealt.mapInArrow(summarise, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard(address: str, n_docs: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, null marks, offsets and ids of one shard as views on its mapped files."""
    offsets = np.frombuffer(map_file(f"{address}.off"), "<i8")
    document = map_file(f"{address}.doc")
    numbers = np.frombuffer(document, "<i8", n_docs)
    nulls = np.frombuffer(document, "u1", n_docs, 8 * n_docs).astype(bool)
    return numbers, nulls, offsets, np.frombuffer(map_file(f"{address}.bin"), dtype)
