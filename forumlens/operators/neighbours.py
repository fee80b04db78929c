"""Approximate nearest vectors by cosine, from an index of codes in tables.

Every vector is projected on ``directions`` directions in each of ``rotations`` sets; a code of the set is the direction it points
to most, or its opposite. A table holds the pairs of codes of two sets: set r and each of the ``partners`` sets that follow it.
A query looks into the buckets of its ``probes`` best codes of either set, those with the smallest margin to the best one, in all tables.
Rows that it meets in ``votes`` tables at least are compared with it exactly.

Directions are sums of hexadecimal digits of md5 hashes and vectors are cut to whole multiples of 1 / ``SCALE``, so codes are the same in
every engine and on every cluster; nothing is fitted. Equal vectors are one entry of the index, so copies fill no bucket.
The index is a table of vectors with their codes and one of copies, staged, or stored and read again. Blocks of queries look into blocks of its
rows, whose buckets are made inside the task; the best rows of a query leave each, so neither a row and its table nor a query and a row it meets is a row of a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.operators.similarity import DIGITS, NEIGHBOURS
from forumlens.session import stage

SCALE = 1 << 15
#: Digits of a hash that make up one component, and what is taken off so that components are about zero on average.
DIGITS_PER_COMPONENT, MIDDLE = 4, 30
COMPONENTS_PER_HASH = 32 // DIGITS_PER_COMPONENT
#: Rows and queries of a block, rows of a block that are written as one, and entries of buckets that are counted at once.
BLOCK_ROWS, BLOCK_QUERIES, STRETCH = 1 << 16, 1 << 14, 1 << 12
ENTRIES = 1 << 21


@dataclass(frozen=True)
class Shape:
    """How many sets of directions and tables an index has, and how far a query looks."""

    rotations: int = 80
    directions: int = 64
    partners: int = 4
    probes: int = 8
    votes: int = 7

    @property
    def tables(self) -> int:
        return self.rotations * self.partners


def directions(shape: Shape, dimensions: int) -> np.ndarray:
    """The directions as whole numbers, (rotation, direction, dimension)."""
    out = np.zeros((shape.rotations, shape.directions, dimensions), np.int64)
    for r in range(shape.rotations):
        for i in range(shape.directions):
            digits = "".join(hashlib.md5(f"{r}/{i}/{block}".encode()).hexdigest()
                             for block in range(-(-dimensions // COMPONENTS_PER_HASH)))
            values = np.array([int(x, 16) for x in digits]).reshape(-1, DIGITS_PER_COMPONENT).sum(axis=1) - MIDDLE
            out[r, i] = values[:dimensions]
    return out


def _coded(vectors: DataFrame, shape: Shape, dimensions: int, best: int) -> DataFrame:
    """(id, vector, codes) of vectors (id, vector): the ``best`` codes of each set, one after the other, the best first."""
    spark = vectors.sparkSession
    every = spark.sparkContext.broadcast(directions(shape, dimensions).astype(np.float64))  # its size is set by the shape
    scale = SCALE

    # a function of its own, so that executors need not have this package
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            matrix = np.zeros((len(rows), every.value.shape[2]))
            for k, row in enumerate(rows):
                matrix[k, :len(row)] = row
            matrix = np.floor(scale * matrix)
            codes = np.zeros((len(rows), len(every.value), best), np.int32)
            for r, of in enumerate(every.value):
                along = matrix @ of.T
                both = np.concatenate((along, -along), axis=1)
                codes[:, r] = both.argmax(axis=1)[:, None] if best == 1 else (-both).argsort(axis=1, kind="stable")[:, :best]
            yield pa.record_batch({"id": batch.column(0), "vector": batch.column(1),
                                   "codes": pa.array(list(codes.reshape(len(rows), -1)), pa.list_(pa.int32()))})

    if vectors.schema["vector"].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "vector")}
    return vectors.select("id", "vector").mapInArrow(code, f"id {kinds['id']}, vector {kinds['vector']}, codes array<int>")


def _buckets(coded: DataFrame, shape: Shape, best: int) -> DataFrame:
    """(table, code, id): the buckets of vectors, or those that queries look into."""
    first, second = F.floor(F.col("t") / shape.partners), F.lit(1) + F.col("t") % shape.partners
    other = (first + second) % shape.rotations
    at = coded.select("id", "codes", F.explode(F.sequence(F.lit(0), F.lit(shape.tables - 1))).alias("t"))
    of = at.select(F.col("t").alias("table"), "id", F.slice("codes", (first * best + 1).cast("int"), F.lit(best)).alias("x"),
                   F.slice("codes", (other * best + 1).cast("int"), F.lit(best)).alias("y"))
    pairs = of.select("table", "id", F.explode("x").alias("x"), "y").select("table", "id", "x", F.explode("y").alias("y"))
    return pairs.select("table", (F.col("x") * (2 * shape.directions) + F.col("y")).alias("code"), "id")


@dataclass(frozen=True)
class NeighbourIndex:
    """``coded`` (id, vector, codes): one row for each distinct vector, named by its smallest id, with its code of each set; ``copies`` (id, copy): all ids of it."""

    coded: DataFrame
    copies: DataFrame
    shape: Shape
    dimensions: int

    @property
    def vectors(self) -> DataFrame:
        return self.coded.select("id", "vector")

    @property
    def codes(self) -> DataFrame:
        """(table, code, id): the bucket of each vector in each table, as rows."""
        return _buckets(self.coded, self.shape, 1)

    def save(self, path: str) -> None:
        for name in ("coded", "copies"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, shape: Shape = Shape()) -> NeighbourIndex:
        coded, copies = (spark.read.parquet(f"{path}/{name}") for name in ("coded", "copies"))
        return cls(coded, copies, shape, _dimensions(coded))


def _dimensions(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vector"))).first()[0] or 1


def _named(vectors: DataFrame) -> DataFrame:
    """(id, vector, copy): each row with the smallest id that has its vector; rows without id or vector, or with a component that is no number, are left out."""
    given = vectors.select("id", "vector").where(F.col("id").isNotNull() & F.col("vector").isNotNull()
                                                 & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    names = stage(given.groupBy("vector").agg(F.min("id").alias("name")))
    return given.withColumnRenamed("id", "copy").join(names, "vector").select(F.col("name").alias("id"), "vector", "copy")


def build(vectors: DataFrame, shape: Shape = Shape()) -> NeighbourIndex:
    """The index of a table of vectors (id, vector); every row is in it."""
    named = stage(_named(vectors))
    distinct = stage(named.where(F.col("id") == F.col("copy")).select("id", "vector").dropDuplicates(["id"]))
    dimensions = _dimensions(distinct)
    return NeighbourIndex(stage(_coded(distinct, shape, dimensions, 1)), named.select("id", "copy"), shape, dimensions)


def _packed(coded: DataFrame, n_blocks: int) -> DataFrame:
    """(block, part, names, codes, sizes, numbers): the rows of each block in ascending order of id, ``STRETCH`` in one row; all but the names are bytes."""
    stretch, kind = STRETCH, coded.schema["id"].dataType.simpleString()

    # a function of its own, so that executors need not have this package
    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["id"]))
        parts = [table.slice(begin, stretch) for begin in range(0, len(table), stretch)]

        def lists(part: pa.Table, column: str) -> pa.Array:
            return part[column].combine_chunks()

        return pa.table({
            "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()),
            "names": pa.array([p["id"].to_pylist() for p in parts], pa.list_(table.schema.field("id").type)),
            "codes": pa.array([lists(p, "codes").flatten().to_numpy(zero_copy_only=False).astype(np.int16).tobytes() for p in parts], pa.binary()),
            "sizes": pa.array([pc.list_value_length(lists(p, "vector")).to_numpy().astype(np.int32).tobytes() for p in parts], pa.binary()),
            "numbers": pa.array([lists(p, "vector").flatten().to_numpy(zero_copy_only=False).tobytes() for p in parts], pa.binary())})

    rows = coded.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "id", "codes", "vector")
    return rows.groupBy("block").applyInArrow(pack, f"block int, part int, names array<{kind}>, codes binary, sizes binary, numbers binary")


def _met(index: NeighbourIndex, queries: DataFrame, keep: int | None) -> DataFrame:
    """(query, id) of the distinct vectors that each query (id, vector) meets often enough; with ``keep``, (query, id, sim) of as many best ones
    (ties by id) of each block of rows, of those that are as long as the query.

    Every block of queries meets every block of rows once. The work and what tasks hold are set by the shape and the sizes of blocks.
    """
    shape, digits = index.shape, DIGITS
    coded = _coded(queries, shape, index.dimensions, shape.probes)
    kinds = {c: [df.schema[c].dataType.simpleString() for df in (coded, index.coded)] for c in ("id", "vector")}
    across, down = (max(1, -(-df.count() // size)) for df, size in ((index.coded, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    left = stage(_packed(index.coded, across)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = stage(_packed(coded, down)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    left = left.withColumn("pair", F.col("block") * F.lit(down).cast("bigint") + F.col("other"))
    right = right.withColumn("of_pair", F.col("other") * F.lit(down).cast("bigint") + F.col("block"))
    number = [np.float32 if k == "array<float>" else np.float64 for k in kinds["vector"]]
    n_codes, tables, partners, probes, votes, entries = 2 * shape.directions, shape.tables, shape.partners, shape.probes, shape.votes, ENTRIES
    first = np.arange(tables) // partners
    second = (first + 1 + np.arange(tables) % partners) % shape.rotations

    # a function of its own, so that executors need not have this package
    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        def unpacked(table: pa.Table, kind) -> tuple:
            table = table.take(pc.sort_indices(table["part"]))
            names = table["names"].combine_chunks().flatten()
            codes, sizes, numbers = (np.frombuffer(b"".join(table[c].to_pylist()), t)
                                     for c, t in (("codes", np.int16), ("sizes", np.int32), ("numbers", kind)))
            matrix = np.zeros((len(names), sizes.max(initial=0)))
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = numbers
            return names, codes.reshape(len(names), -1).astype(np.int64), sizes, matrix

        names, wanted, lengths, vectors = unpacked(asked, number[0])
        ids, codes, sizes, matrix = unpacked(rows, number[1])
        n, size = len(ids), n_codes * n_codes
        if not n or not len(names):
            out = {"query": names.slice(0, 0), "id": ids.slice(0, 0)}
            return pa.table(out if keep is None else {**out, "sim": pa.array([], pa.float64())})
        # the rows of each bucket, table after table, and where each bucket begins
        order, begin = np.empty(tables * n, np.int32), np.empty((tables, size + 1), np.int64)
        for t in range(tables):
            bucket = codes[:, first[t]] * n_codes + codes[:, second[t]]
            order[t * n:(t + 1) * n] = np.argsort(bucket.astype(np.uint16 if size <= 1 << 16 else np.int64), kind="stable")
            begin[t, 0] = t * n
            begin[t, 1:] = t * n + np.cumsum(np.bincount(bucket, minlength=size))
        begin, offset = begin.reshape(-1), (np.arange(tables) * (size + 1))[:, None, None]
        norms, its_norms = np.sqrt((matrix * matrix).sum(axis=1)), np.sqrt((vectors * vectors).sum(axis=1))
        found = []
        for q in range(len(names)):
            best = wanted[q].reshape(-1, probes)
            at = (offset + best[first][:, :, None] * n_codes + best[second][:, None, :]).reshape(-1)
            start = begin[at]
            counts = begin[at + 1] - start
            some = np.flatnonzero(counts)
            start, counts = start[some], counts[some]
            ends = np.cumsum(counts)
            met, a = np.zeros(n, np.int64), 0
            while a < len(ends):  # a stretch of buckets with about as many entries as are counted at once
                before = ends[a] - counts[a]
                b = max(a + 1, int(np.searchsorted(ends, before + entries, side="right")))
                place = np.arange(ends[b - 1] - before) + np.repeat(start[a:b] - (ends[a:b] - counts[a:b] - before), counts[a:b])
                met += np.bincount(order[place], minlength=n)
                a = b
            near = np.flatnonzero(met >= votes)
            if keep is None:
                found.append((np.full(len(near), q), near, np.zeros(0)))
                continue
            near = near[sizes[near] == lengths[q]]
            dots, length = matrix[near, :lengths[q]] @ vectors[q, :lengths[q]], norms[near] * its_norms[q]
            sims = np.divide(dots, length, out=np.zeros(len(near)), where=~(length <= 0))
            sims = np.copysign(np.floor(np.abs(sims) * 10.0 ** digits + 0.5) / 10.0 ** digits, sims) + 0.0
            down = -np.where(np.isnan(sims), np.inf, sims)
            if len(near) > keep:
                good = np.flatnonzero(down <= np.partition(down, keep - 1)[keep - 1])
                good = good[np.argsort(down[good], kind="stable")[:keep]]  # ids ascend
                near, sims = near[good], sims[good]
            found.append((np.full(len(near), q), near, sims))
        q, near, sims = (np.concatenate(parts) for parts in zip(*found))
        out = {"query": names.take(pa.array(q)), "id": ids.take(pa.array(near))}
        return pa.table(out if keep is None else {**out, "sim": pa.array(sims)})

    schema = f"query {kinds['id'][0]}, id {kinds['id'][1]}" + ("" if keep is None else ", sim double")
    return left.groupBy("pair").cogroup(right.groupBy("of_pair")).applyInArrow(meet, schema)


def candidates(index: NeighbourIndex, queries: DataFrame) -> DataFrame:
    """(query, id) of the distinct vectors that each query (id, vector) meets often enough."""
    return _met(index, queries, None)


def search(index: NeighbourIndex, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(target, id, sim, rank): the k most similar other rows of each query (id, vector) among those it is compared with.

    A query that meets fewer than k rows has fewer neighbours; vectors of other lengths than its own are none. Queries with one vector are asked once; of the rows
    with one vector, at most k + 1 are ever in the result.
    """
    named = stage(_named(queries))
    asked = stage(named.where(F.col("id") == F.col("copy")).select("id", "vector").dropDuplicates(["id"]))
    def first(df: DataFrame, n: int, by: str, *order) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)

    ids = first(index.copies, k + 1, "id", F.asc("copy")).drop("rank")
    best = first(_met(index, asked, k + 1), k + 1, "query", F.desc("sim"), F.asc("id")).drop("rank")
    rows = stage(first(best.join(ids, "id").select("query", F.col("copy").alias("id"), "sim"), k + 1, "query", F.desc("sim"), F.asc("id"))
                 .drop("rank"))
    each = named.select(F.col("id").alias("query"), F.col("copy").alias("target")).join(rows, "query").where(F.col("target") != F.col("id"))
    return first(each.select("target", "id", "sim"), k, "target", F.desc("sim"), F.asc("id"))
