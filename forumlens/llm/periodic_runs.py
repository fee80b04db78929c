"""Periodic runs of words: stretches that repeat a short sequence of words four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
``MIN_WORDS`` and ``MIN_PERIODS`` periods that no neighbouring word extends. Words are what stands between spaces and the
control characters 9 to 13, as they are written.

Recursive frequency splitting: every word of a run occurs ``MIN_PERIODS`` times in it, so a word that occurs less often in
its segment is in no run and splits the segment there. The parts are counted again until none of them splits; all segments
of a batch of texts are counted together by one sort, and only those that changed are counted anew. What survives is scanned
lag by lag. For lag q a segment is cut into blocks of q words; a run covers three whole blocks, so only where two
neighbours of blocks in a row have equal sums of hashes are words compared, which also finds both ends. This takes a share of 1 / q
of the segment for lag q. A run with period q and one with a longer period p share less than p + q words, so what lies
deeper in a known run is left out for longer lags. Hashes only choose where words are compared: the runs are exact.

Null and empty texts, and texts without words, have no runs. Each row is judged alone, so rows keep their number, repeated
ids and rows do no harm, and other columns are left behind. Long texts cost about n log n steps. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import map_batches, record_batch
from forumlens.llm.hashing import mix

MIN_PERIODS = 4
MIN_WORDS = 6

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least(period: int) -> int:
    """Words that a run of this period has at least."""
    return max(MIN_WORDS, MIN_PERIODS * period)


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word of all texts, equal for equal words, and the number of words before each text."""
    codes = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes[~space]))])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return numbers, np.concatenate(([0], np.searchsorted(begin, stops)))


def segments(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the stretches in which every word occurs often enough for a run; ``first`` has the texts' first words."""
    places = np.arange(len(words))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stable = []
    while len(places):
        _, inverse, counts = np.unique(segment * (int(words.max()) + 1) + words[places], return_inverse=True, return_counts=True)
        rare = counts[inverse] < MIN_PERIODS
        changed = np.zeros(int(segment[-1]) + 1, bool)
        changed[segment[rare]] = True
        settled = ~changed[segment]
        stable.append((places[settled], segment[settled]))
        kept = ~rare & ~settled
        places, old = places[kept], segment[kept]
        if len(places):
            begins = np.concatenate(([True], (np.diff(places) != 1) | (np.diff(old) != 0)))
            segment = np.cumsum(begins) - 1
            enough = np.bincount(segment)[segment] >= MIN_WORDS
            places, segment = places[enough], segment[enough]
    found = []
    for where, number in stable:
        if len(where):
            begin = np.flatnonzero(np.concatenate(([True], np.diff(number) != 0)))
            end = np.append(begin[1:], len(where)) - 1
            found += [(a, b + 1) for a, b in zip(where[begin].tolist(), where[end].tolist()) if b + 1 - a >= MIN_WORDS]
    return found


def _stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of each stretch that is true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _open(size: int, deep: list[tuple[int, int, int]], lag: int) -> list[tuple[int, int]]:
    """What is left of a segment without the inside of known runs (start, end, period) that no run of a longer period reaches."""
    left, at = [], 0
    for start, end, period in sorted(deep):
        margin = lag + period
        if start + margin >= end - margin:
            continue
        if start + margin > at:
            left.append((at, start + margin))
        at = max(at, end - margin)
    return [*left, (at, size)]


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    size = len(words)
    powers = np.full(size, _BASE, np.uint64)
    powers[:1] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
        mix(words.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)))
    found: dict[tuple[int, int], int] = {}
    deep: list[tuple[int, int, int]] = []
    shift = np.ones(1, np.uint64)
    for lag in range(1, size // MIN_PERIODS + 1):
        shift = shift * np.uint64(_BASE)
        deep = [d for d in deep if d[1] - d[0] > 2 * (lag + d[2])]
        new = []
        for a, b in _open(size, deep, lag) if deep else [(0, size)]:
            if b - a < least(lag):
                continue
            block = np.diff(sums[a:b + 1:lag])
            same = block[:-1] * shift == block[1:]
            if not (same[1:] & same[:-1]).any():
                continue
            for k, stop in _stretches(same):
                if stop - k > 1:
                    new += _around(words, a + k * lag, a + (stop + 1) * lag, lag)
        for start, end in new:
            if end - start >= least(lag) and (start, end) not in found:
                found[start, end] = lag
                deep.append((start, end, lag))
    return [(start, end - start, lag) for (start, end), lag in found.items()]


def _around(words: np.ndarray, begin: int, end: int, lag: int) -> list[tuple[int, int]]:
    """The longest stretches with this lag that lie in [begin, end) or reach beyond it."""
    while begin > 0 and words[begin - 1] == words[begin - 1 + lag]:
        step = min(lag, begin)
        differ = np.flatnonzero(words[begin - step:begin] != words[begin - step + lag:begin + lag])
        begin = begin - step + (int(differ[-1]) + 1 if len(differ) else 0)
    while end < len(words) and words[end] == words[end - lag]:
        step = min(lag, len(words) - end)
        differ = np.flatnonzero(words[end:end + step] != words[end - lag:end - lag + step])
        end += int(differ[0]) if len(differ) else step
    same = words[begin:end - lag] == words[begin + lag:end]
    return [(begin + a, begin + b + lag) for a, b in _stretches(same)]


def runs_of(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """The runs of each text by start and period, and the number of words of each."""
    words, first = numbered_words(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in segments(words, first):
        text = int(np.searchsorted(first, begin, "right")) - 1
        offset = begin - int(first[text])
        found[text] += [(start + offset, length, period) for start, length, period in lag_scan(words[begin:end])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found], np.diff(first)


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that come after the first period of a run they are in."""
    words = text.split()  # bytes are split at space and 9 to 13
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        found, sizes = runs_of(texts)
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in of] for of in found]
        yield record_batch(doc_id=batch.column(0), n_words=sizes.astype(np.int64), runs=pa.array(runs, _RUNS),
                           collapsed=pa.array([collapsed(t, of) for t, of in zip(texts, found)], pa.binary()))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of documents (doc_id, text).

    ``runs`` has (start, length, period), counted in words from 0, by start and then period; ``collapsed`` is the text with
    every run cut to its first period and one space between words.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = map_batches(rows, _find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
                                     "collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
