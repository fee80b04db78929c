"""A quality classifier from naive Bayes support vectors.

A document is the set of its n-grams: byte n-grams of one to four bytes, and n-grams over a string that says for each word
whether it repeats one of the two words before it. They are hashed to ``2 ** BITS`` places. An indicator is scaled by its
class log-count ratio, rows are brought to unit length, and a linear model with hinge loss is fitted by dual coordinate
descent over the scaled indicators. A document's score is a logistic function of the margin.

The model is fitted in one task on at most about ``SAMPLE_ROWS`` labelled rows, drawn by hash over the whole label table;
this bounds its memory. Its weights are one array of fixed size, which scoring tasks read as a broadcast.

Inputs of a score are the text alone. Null texts are empty; an empty text is scored by the bias. Labels other than 0 and 1
are left out; a label for several rows, or several labels for one, each make a row. Without labels of both classes all
scores are 0.5. Repeated rows are scored each, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import documents, map_batches, record_batch
from forumlens.session import stage

BITS = 18
SAMPLE_ROWS = 8000
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 20
SLOPE = 4.0

_CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _mark(codes: np.ndarray, longest: int, salt: int, marks: np.ndarray) -> None:
    """Set the places of all n-grams of up to ``longest`` codes (0 to 255)."""
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        if len(codes) < n:
            return
        gram = (gram[:len(codes) - n + 1] << np.uint64(8)) | codes[n - 1:]
        mixed = (gram + np.uint64(salt + n)) * np.uint64(0x9E3779B97F4A7C15)
        marks[mixed >> np.uint64(64 - BITS)] = True


def features(text: bytes) -> np.ndarray:
    """Sorted places of the n-grams that a text has; long texts are read in overlapping chunks."""
    marks = np.zeros(1 << BITS, bool)
    for begin in range(0, len(text), _CHUNK):
        _mark(np.frombuffer(text[begin:begin + _CHUNK + 3], np.uint8).astype(np.uint64), 4, 0, marks)
    words = text.split()
    if words:
        again = bytes(1 if a == b else 2 if a == c else 0 for a, b, c in zip(words, [b"", *words], [b"", b"", *words]))
        _mark(np.frombuffer(again, np.uint8).astype(np.uint64), 4, 1 << 40, marks)
    return np.flatnonzero(marks).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    counts = [np.full(1 << BITS, SMOOTHING) for _ in range(2)]
    for places, label in zip(rows, positive):
        counts[int(label)][places] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_model(rows: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by place with the bias last, and ratios by place; rows of the rarer class count as much in total as those of the other.

    Dual coordinate descent for the L2-regularised hinge loss: one dual variable per row, between 0 and the row's cost,
    moved to its optimum in turn while the weights follow. Rows are visited in an order fixed by a seed.
    """
    n_positive = int(positive.sum())
    if not 0 < n_positive < len(rows):
        return np.zeros((1 << BITS) + 1, np.float32), np.zeros(1 << BITS, np.float32)
    ratio = log_count_ratio(rows, positive)
    sign = np.where(positive, 1.0, -1.0)
    cost = PENALTY * len(rows) / 2 / np.where(positive, n_positive, len(rows) - n_positive)
    scale = [1 / max(np.sqrt(np.square(ratio[places]).sum()), 1e-12) for places in rows]
    weights, bias, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            places = rows[i]
            values = ratio[places] * scale[i]
            gradient = sign[i] * (weights[places] @ values + bias) - 1
            step = np.clip(dual[i] - gradient / 2, 0, cost[i]) - dual[i]  # a row and its bias input have length 1 each
            if step:
                dual[i] += step
                weights[places] += step * sign[i] * values
                bias += step * sign[i]
    return np.append(weights, bias).astype(np.float32), ratio.astype(np.float32)


def _model(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "label", "places"])
    weights, ratio = fit_model([np.frombuffer(p, np.int32) for p in rows["places"]], rows["label"].to_numpy() == 1)
    return pd.DataFrame({"weights": [weights.tobytes()], "ratio": [ratio.tobytes()]})


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label, places) of a sample of the labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = usable.count()
    share = min(1.0, sample_rows / max(n, 1))
    place = F.pmod(F.xxhash64("doc_id", "label"), F.lit(1 << 30))
    drawn = F.broadcast(usable.where(place < int(share * (1 << 30)) + (share == 1.0)))  # at most about sample_rows rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [features(t or b"").tobytes() for t in batch.column(2).to_pylist()]
            yield record_batch(doc_id=batch.column(0), label=batch.column(1), places=pa.array(places, pa.binary()))

    joined = documents(docs).join(drawn, "doc_id").select("doc_id", "label", F.col("text").cast("binary"))
    return map_batches(joined, encode, "doc_id long, label int, places binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Products of weights and ratios by place, the ratios' squares, and the bias, as (2, 2 ** BITS + 1) floats."""
    rows = training_rows(docs, labels, label, sample_rows)
    model = stage(rows.groupBy().applyInPandas(_model, "weights binary, ratio binary")).first()
    if model is None:
        return np.zeros((2, (1 << BITS) + 1), np.float32)
    weights, ratio = (np.frombuffer(bytes(part), np.float32) for part in model)
    return np.stack([np.append(weights[:-1] * ratio, weights[-1]), np.append(np.square(ratio), 0)]).astype(np.float32)


def margin(model: np.ndarray, places: np.ndarray) -> float:
    length = float(np.sqrt(model[1][places].sum(dtype=np.float64)))
    return float(model[0][places].sum(dtype=np.float64)) / max(length, 1e-12) + float(model[0][-1])


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, score, predicted) of every row; the score is rounded to nine digits."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            margins = np.array([margin(known, features(t or b"")) for t in batch.column(1).to_pylist()])
            scores = np.round(1 / (1 + np.exp(-SLOPE * np.clip(margins, -100, 100))), 9)
            yield record_batch(doc_id=batch.column(0), score=scores, predicted=(scores >= 0.5).astype(np.int32))

    rows = documents(docs).select("doc_id", F.col("text").cast("binary"))
    return map_batches(rows, predict, "doc_id long, score double, predicted int")
