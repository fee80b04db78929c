"""Best-fit packing by sums of squares: documents into sequences of a fixed number of tokens.

A document's ids are followed by an end id; only a document longer than the capacity is cut, into pieces of exactly the
capacity and a shorter last one. A piece goes where the sum of the squared counts of open sequences per residual gap becomes
smallest, which keeps gaps of all sizes in stock, as later pieces need them. Choices depend on lengths alone, so only
lengths travel. Pieces are dealt at random into groups of bounded size that are packed apart, largest first; a group
wastes at most a few sequences, so many pieces per group cost little space.

Null texts are empty and take one place (the end id); repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import documents, map_batches, record_batch, ship_package
from forumlens.llm.tokenize import encoder
from forumlens.session import stage

GROUP_PIECES = 100_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order.

    ``open_at[g]`` counts the open sequences with gap g. Putting a length s into a sequence with gap g turns one count at g
    into one at g - s; of the squares only those two change, by 2 (open_at[g - s] - open_at[g]) + 2. Gap 0 is closed
    and not counted; a new sequence takes nothing away. Ties go to the smallest gap.
    """
    open_at = np.zeros(capacity + 1, np.int64)
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap, lowest number first
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    never, n = np.iinfo(np.int64).max, 0
    for i, s in enumerate(lengths.tolist()):
        after = 2 * open_at[: capacity - s + 1] + 1  # cost of the count that is added, by gap afterwards
        after[0] = 0
        fits = open_at[s:]
        change = np.where(fits > 0, after - 2 * fits + 1, never)
        best = int(np.argmin(change))
        if change[best] <= after[capacity - s]:
            gap = best + s
            open_at[gap] -= 1
            chosen = heapq.heappop(stock[gap])
        else:
            gap, chosen, n = capacity, n, n + 1
        sequence[i], offset[i] = chosen, capacity - gap
        if gap - s:
            open_at[gap - s] += 1
            heapq.heappush(stock[gap - s], chosen)
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place) of every piece of every document.

    ``place`` numbers the rows of this table; a staged copy keeps it.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end, place = np.array([end_id], words.dtype).tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for number, found in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = np.frombuffer(found + end, words.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    rows.append((number, piece, start, len(part), zlib.crc32(part), place))
                    place += 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield record_batch(**{n: pa.array(c, k) for n, c, k in zip(
                ("doc_id", "piece", "start", "length", "ids_crc32", "place"), columns, kinds)})

    return map_batches(documents(docs), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")


def pack(lengths: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a stored table with length (1 to capacity) and place, a number of the row.

    Sequences are numbered within their group; the group is in the upper bits. Rows of a group are sorted, so a task
    that is run again places them alike.
    """
    groups = max(1, -(-lengths.count() // group_pieces))
    group = F.pmod(F.xxhash64("place"), F.lit(groups))
    kept = [c for c in lengths.columns if c not in ("sequence_id", "offset", "packing_group")]

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "place"], ascending=[False, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        placed = rows.assign(sequence_id=(rows["packing_group"].to_numpy() << 32) + sequence, offset=offset)
        return placed.drop(columns="packing_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.select(*kept).schema)
    ship_package(lengths.sparkSession)
    grouped = lengths.select(*kept, group.alias("packing_group")).groupBy("packing_group")
    return grouped.applyInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(stage(pieces(docs, tokenizer, end_id, capacity)), capacity).drop("place")
