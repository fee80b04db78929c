"""Word vectors learnt from the posts themselves: words that stand beside the same words get similar vectors.

Words within ``WINDOW`` places of each other are counted, counts become positive pointwise mutual information, and the symmetric
matrix of these is factorised: its leading eigenvectors, each times the root of its eigenvalue's size, are the coordinates. The block of directions is multiplied by
the matrix in blocks of words, which are written once and stay where they lie: a round moves the directions of each block's words, not the pairs, and only
inner products of directions reach the driver. Rounds end when the leading eigenvalues stand still; what they still moved by is reported.

Words are dealt into buckets, and a word is known by its bucket and its place there. Pairs are counted in blocks of posts and move as arrays to the cell of
their two buckets, where they are added up; information and products are made in the same cells, each pair held once for both orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.operators.blocks import Blocks, blocks, in_buckets
from forumlens.operators.tfidf import in_blocks
from forumlens.session import stage

WINDOW = 4
MIN_COUNT = 5
DIMENSIONS = 8
ROUNDS = 8
TOLERANCE = 1e-3
#: Words whose pairs one task multiplies together.
BLOCK_WORDS = 4096
#: Pairs, counted with repeats, that one cell is made for, and entries written as one array.
CELL_PAIRS = 1 << 22
STRETCH = 1 << 20


def _codec() -> tuple[Callable, Callable]:
    """Numbers as bytes, first bytes first, since upper ones are mostly zeros and shrink, and back. Functions of their own, so that executors need not have
    this package."""
    def planes(values: np.ndarray, kind: type) -> bytes:
        return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()

    def numbers(column: list[bytes], kind: type) -> np.ndarray:
        wide = np.dtype(kind).itemsize
        parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(wide, -1).T).view(kind).ravel() for b in column]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    return planes, numbers


@dataclass(frozen=True)
class Cells:
    """A symmetric table of words in cells: ``words`` (term, bucket, place), ``entries`` (cell, i, j, x), where the cell of the buckets p <= q is p * ``buckets`` + q
    and ``i``, ``j`` and ``x`` are bytes of the places in p and in q, and of numbers of the type ``kind``. An entry stands for both orders of its words.
    Entries that many rounds read are a table ``name`` in buckets, which is not shuffled again."""

    words: DataFrame
    entries: DataFrame
    buckets: int
    kind: str
    name: str | None = None

    def drop(self) -> None:
        """Forget the table's name, once no result is read any more that is not staged."""
        self.words.sparkSession.sql(f"DROP TABLE {self.name}")

    def with_buckets(self, of_bucket: DataFrame) -> DataFrame:
        """A table with a column ``bucket`` as (of_cell, ...), its rows once for each cell of the bucket."""
        n, b = self.buckets, F.col("bucket")
        cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda q: F.least(b, q) * n + F.greatest(b, q))
        return of_bucket.withColumn("of_cell", F.explode(cells))

    def times(self, vectors: DataFrame) -> DataFrame:
        """(row, numbers...): the table times ``vectors`` (word, numbers...), one row a word; a word without a vector counts as 0."""
        buckets, kind, names, (_, numbers) = self.buckets, self.kind, vectors.columns[1:], _codec()
        width = len(names)

        # functions of their own, so that executors need not have this package
        def pack(rows: pa.Table) -> pa.Table:
            place = rows["place"].to_numpy()
            v = np.zeros((int(place.max()) + 1, width))
            v[place] = np.column_stack([rows[c].to_numpy() for c in names])
            return pa.table({"bucket": rows["bucket"].slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

        def product(entries: pa.Table, given: pa.Table) -> pa.Table:
            found = []
            if len(entries):
                p, q = divmod(entries["cell"][0].as_py(), buckets)
                i, j, x = (numbers(entries[c].to_pylist(), k) for c, k in (("i", np.int32), ("j", np.int32), ("x", kind)))
                v = {b: np.frombuffer(data, np.float64).reshape(-1, width) for b, data in zip(given["bucket"].to_pylist(), given["v"].to_pylist())}

                def sums(rows: np.ndarray, columns: np.ndarray, x: np.ndarray, of: np.ndarray | None) -> np.ndarray:
                    out = np.zeros((int(rows.max(initial=-1)) + 1, width))
                    if of is not None:
                        short = int(columns.max(initial=-1)) + 1 - len(of)
                        of = np.concatenate((of, np.zeros((max(short, 0), width))))
                        for c in range(width):
                            out[:, c] = np.bincount(rows, weights=x * np.ascontiguousarray(of[:, c])[columns], minlength=len(out))
                    return out

                found.append((p, sums(i, j, x, v.get(q))))
                other = (i != j) | (p != q)
                found.append((q, sums(j[other], i[other], x[other], v.get(p))))
            return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "y": pa.array([y.tobytes() for _, y in found], pa.binary())})

        def total(words: pa.Table, parts: pa.Table) -> pa.Table:
            out = np.zeros((len(words), width))
            for y in parts["y"].to_pylist():
                y = np.frombuffer(y, np.float64).reshape(-1, width)
                out[:len(y)] += y
            place = words["place"].to_numpy()
            return pa.table({"row": words["term"], **{c: out[place, k] for k, c in enumerate(names)}})

        known = self.words.join(vectors.withColumnRenamed(vectors.columns[0], "term"), "term").select("bucket", "place", *names)
        arrays = self.with_buckets(known.groupBy("bucket").applyInArrow(pack, "bucket int, v binary"))
        parts = self.entries.groupBy("cell").cogroup(arrays.groupBy("of_cell")).applyInArrow(product, "bucket int, y binary")
        schema = ", ".join(["row string", *(f"`{c}` double" for c in names)])
        return self.words.groupBy("bucket").cogroup(parts.select(F.col("bucket").alias("of_bucket"), "y").groupBy("of_bucket")).applyInArrow(total, schema)


def _counted(docs: DataFrame, words: str, window: int, min_count: int) -> Cells:
    """How often words used ``min_count`` times or more stand less than ``window`` places apart, staged; a word beside itself counts twice."""
    used = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    sizes = F.when(F.col(words).isNotNull(), F.size(words)).cast("bigint")
    n_pairs = (docs.agg(F.sum(sizes)).first()[0] or 0) * max(window - 1, 0)
    buckets = max(1, int(np.ceil(np.sqrt(2 * n_pairs / CELL_PAIRS))))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("word")) - 1
    frequent = used.where(F.col("word").isNotNull() & (F.col("uses") >= min_count)).select("word", bucket.alias("bucket"))
    known = stage(frequent.select(F.col("word").alias("term"), "bucket", place.alias("place")))
    planes, numbers = _codec()
    stretch = STRETCH

    # functions of their own, so that executors need not have this package
    def count(posts: pa.Table, known: pa.Table, post: np.ndarray, at: np.ndarray) -> pa.Table:
        bucket, place = (known[c].to_numpy() for c in ("bucket", "place"))
        order = np.lexsort((place, bucket))
        rank = np.empty(len(order) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(order)), -1
        code, n = rank[at], max(len(order), 1)
        keys, times, size = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate([np.zeros(0, np.int64), *keys])
            by = np.argsort(key, kind="stable")
            key, weight = key[by], np.concatenate([np.zeros(0, np.int64), *times])[by]
            begin = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
            return key[begin], np.add.reduceat(weight, begin) if len(begin) else weight

        for d in range(1, window):
            a, b = code[:max(len(code) - d, 0)], code[d:]
            some = (a >= 0) & (b >= 0) & (post[:len(a)] == post[d:])
            key, weight = np.unique(np.minimum(a[some], b[some]) * n + np.maximum(a[some], b[some]), return_counts=True)
            keys.append(key)
            times.append(weight)
            size += len(key)
            if size > 1 << 24:
                key, weight = summed()
                keys, times, size = [key], [weight], 0
        key, weight = summed()
        first, second = order[key // n], order[key % n]
        weight = weight * np.where(first == second, 2, 1)
        cell = bucket[first].astype(np.int64) * buckets + bucket[second]
        by = np.argsort(cell, kind="stable")
        cell, i, j, weight = cell[by], place[first[by]], place[second[by]], weight[by]
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(cell), 1), bool), cell[1:] != cell[:-1])))
        parts = list(zip(begin, np.append(begin[1:], len(cell))))
        return pa.table({"cell": pa.array(cell[begin], pa.int32()),
                         **{c: pa.array([planes(v[b:e], k) for b, e in parts], pa.binary()) for c, v, k in
                            (("i", i, np.int32), ("j", j, np.int32), ("x", weight, np.int64))}})

    def merge(counted: pa.Table) -> pa.Table:
        i, j, x = (numbers(counted[c].to_pylist(), k) for c, k in (("i", np.int32), ("j", np.int32), ("x", np.int64)))
        key = i.astype(np.int64) << 32 | j
        by = np.argsort(key, kind="stable")
        key, x = key[by], x[by]
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        key, x = key[begin], np.add.reduceat(x, begin) if len(begin) else x
        parts = range(0, len(key), stretch)
        return pa.table({"cell": pa.array([counted["cell"][0].as_py()] * len(parts), pa.int32()),
                         **{c: pa.array([planes(v[b:b + stretch], k) for b in parts], pa.binary()) for c, v, k in
                            (("i", key >> 32, np.int32), ("j", key & 0xFFFFFFFF, np.int32), ("x", x, np.int64))}})

    schema = "cell int, i binary, j binary, x binary"
    entries = in_blocks(docs, known, count, schema, terms=words, gaps=True).groupBy("cell").applyInArrow(merge, schema)
    return Cells(known, stage(entries), buckets, "int64")


def cooccurrences(docs: DataFrame, words: str = "words", window: int = WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, context, n): how often two words, each used ``min_count`` times or more, stand less than ``window`` places apart, both ways.

    ``docs`` (id, words) is a staged or stored table. Pairs are counted in blocks of posts, once for both orders, and become rows where their words' names meet them;
    a pair is written both ways. Rarer words keep their places but get no vector.
    """
    counted = _counted(docs, words, window, min_count)
    buckets, kind, (_, numbers) = counted.buckets, counted.kind, _codec()

    def named(entries: pa.Table, words: pa.Table) -> pa.Table:
        i, j, n = (numbers(entries[c].to_pylist(), k) for c, k in (("i", np.int32), ("j", np.int32), ("x", kind)))
        p, q = divmod(entries["cell"][0].as_py(), buckets) if len(entries) else (0, 0)

        def names(bucket: int, places: np.ndarray) -> pa.Array:
            mine = words.filter(pc.equal(words["bucket"], bucket))
            return mine["term"].combine_chunks().take(pc.sort_indices(mine["place"])).take(pa.array(places))

        other = (i != j) | (p != q)
        a, b = names(p, i), names(q, j)
        back = pa.array(np.flatnonzero(other))
        return pa.table({"word": pa.chunked_array([a, b.take(back)]), "context": pa.chunked_array([b, a.take(back)]),
                         "n": pa.chunked_array([pa.array(n), pa.array(n[other])])})

    return counted.entries.groupBy("cell").cogroup(counted.with_buckets(counted.words).groupBy("of_cell")).applyInArrow(
        named, "word string, context string, n long")


def _informed(counted: Cells) -> Cells:
    """The positive pointwise mutual information of counted pairs, staged; see ``mutual_information``."""
    totals = stage(counted.times(counted.words.select("term", F.lit(1.0).alias("total"))).join(counted.words.withColumnRenamed("term", "row"), "row").select(
        "bucket", "place", F.col("total").cast("bigint").alias("total")))
    total = int(totals.agg(F.sum("total")).first()[0] or 0)
    buckets, kind, (planes, numbers) = counted.buckets, counted.kind, _codec()

    def pack(rows: pa.Table) -> pa.Table:
        of = np.zeros(len(rows), np.int64)
        of[rows["place"].to_numpy()] = rows["total"].to_numpy()
        return pa.table({"bucket": rows["bucket"].slice(0, 1), "totals": pa.array([of.tobytes()], pa.binary())})

    def inform(entries: pa.Table, given: pa.Table) -> pa.Table:
        of = {b: np.frombuffer(t, np.int64).astype(float) for b, t in zip(given["bucket"].to_pylist(), given["totals"].to_pylist())}
        found = {c: [] for c in ("cell", "i", "j", "x")}
        for cell, *parts in zip(*(entries[c].to_pylist() for c in ("cell", "i", "j", "x"))):
            i, j, n = (numbers([part], k) for part, k in zip(parts, (np.int32, np.int32, kind)))
            p, q = divmod(cell, buckets)
            x = np.log(n.astype(float) * total / (of[p][i] * of[q][j]))
            some = x > 0
            found["cell"].append(cell)
            for c, v, k in (("i", i, np.int32), ("j", j, np.int32), ("x", x, np.float64)):
                found[c].append(planes(v[some], k))
        return pa.table({"cell": pa.array(found["cell"], pa.int32()), **{c: pa.array(found[c], pa.binary()) for c in ("i", "j", "x")}})

    arrays = counted.with_buckets(totals.groupBy("bucket").applyInArrow(pack, "bucket int, totals binary"))
    entries = counted.entries.groupBy("cell").cogroup(arrays.groupBy("of_cell")).applyInArrow(inform, "cell int, i binary, j binary, x binary")
    name, table = in_buckets(entries, "cell")
    return Cells(counted.words, table, buckets, "float64", name)


def mutual_information(counts: DataFrame) -> DataFrame:
    """(word, context, x): positive pointwise mutual information of staged counts; pairs that meet no more than by chance are left out."""
    totals = stage(counts.groupBy("word").agg(F.sum("n").alias("total")))
    total = totals.agg(F.sum("total")).scalar()
    share = F.col("n") * total / (F.col("total").cast("double") * F.col("of_context"))
    joined = counts.join(totals, "word").join(totals.toDF("context", "of_context"), "context")
    return joined.select("word", "context", F.log(share).alias("x")).where(F.col("x") > 0)


@dataclass(frozen=True)
class WordVectors:
    """``vectors`` (word, vector: array of doubles), how many rounds were made, and by what share the leading values moved in the last."""

    vectors: DataFrame
    rounds: int
    moved: float


def _turned(rows: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """(word, v) with the array ``column`` times a small matrix."""
    def product(j: int) -> Column:
        weights = F.array(*(F.lit(float(x)) for x in matrix[:, j]))
        return F.aggregate(F.zip_with(column, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return rows.select("word", F.array(*(product(j) for j in range(matrix.shape[1]))).alias("v"))


def _products(rows: DataFrame, left: str, right: str, size: int) -> np.ndarray:
    sums = [F.coalesce(F.sum(F.get(left, F.lit(i)) * F.get(right, F.lit(j))), F.lit(0.0)).alias(f"p{i}_{j}")
            for i in range(size) for j in range(size)]
    return np.array(rows.agg(*sums).first()).reshape(size, size)


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors * np.where(values > 1e-13 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def factorise(information: DataFrame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> WordVectors:
    """Word vectors from a staged table (word, context, x), the same for both orders of a pair.

    The start depends on the words alone, and each coordinate's sign makes its largest entry positive, so vectors are the same on any cluster.
    """
    words = stage(information.select("word").distinct())
    matrix = blocks(information, "word", "context", "x", max(1, -(-words.count() // BLOCK_WORDS)))
    found = _factorised(words, matrix, dimensions, rounds, tolerance)
    matrix.drop()
    return found


def _factorised(words: DataFrame, matrix: Blocks | Cells, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> WordVectors:
    """Word vectors of staged ``words`` (word), those that the matrix has."""
    start = F.array(*(((F.pmod(F.xxhash64("word", F.lit(j)), F.lit(1 << 20)) + 0.5) / float(1 << 20) - 0.5) for j in range(dimensions)))
    current = stage(words.select("word", start.alias("v")))
    current = stage(_turned(current, "v", _inverse_root(_products(current, "v", "v", dimensions))))
    before, moved, made = None, float("inf"), 0
    while True:
        made += 1
        met = matrix.times(current.select("word", *(F.get("v", F.lit(j)).alias(f"a{j}") for j in range(dimensions))))
        sums = met.select(F.col("row").alias("word"), F.array(*(f"a{j}" for j in range(dimensions))).alias("a"))
        both = stage(current.join(sums, "word"))
        values, rotation = np.linalg.eigh((lambda m: (m + m.T) / 2)(_products(both, "v", "a", dimensions)))
        order = np.argsort(-abs(values), kind="stable")
        values, rotation = values[order], rotation[:, order]
        leading = abs(values[:max(1, dimensions // 2)])
        moved = float("inf") if before is None else float(abs(leading - before).max() / max(leading.max(), 1e-300))
        if moved <= tolerance or made == rounds:
            break
        before = leading
        current = stage(_turned(both, "a", _inverse_root(_products(both, "a", "a", dimensions))))
    axes = stage(_turned(both, "v", rotation * np.sqrt(abs(values))))
    largest = axes.agg(*(F.max_by(F.get("v", F.lit(j)), F.struct(F.round(F.abs(F.get("v", F.lit(j))), 9), "word")).alias(f"l{j}")
                         for j in range(dimensions))).first()
    signs = F.array(*(F.lit(-1.0 if (x or 0.0) < 0 else 1.0) for x in largest))
    return WordVectors(axes.select("word", F.zip_with("v", signs, lambda a, s: a * s).alias("vector")), made, moved)


def learn(docs: DataFrame, words: str = "words", **options) -> WordVectors:
    """Word vectors of a staged table of posts (id, words): counts, information and products are made in the same cells of words."""
    matrix = _informed(_counted(docs, words, WINDOW, MIN_COUNT))
    ones = matrix.times(matrix.words.select("term", F.lit(1.0).alias("x")))
    found = _factorised(stage(ones.where(F.col("x") > 0).select(F.col("row").alias("word"))), matrix, **options)
    matrix.drop()
    return found
