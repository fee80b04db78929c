"""Hard negatives of anchors: rows of another label that score nearly as high as an anchor's positives. Exact.

Vectors are arrays of integers and a score is their inner product with the anchor; higher scores come first, ties by smaller vec_id.
An anchor's positives are its best rows of the same label; the negatives of a positive are the best rows of other labels whose score
lies between ``LOW`` / ``OF`` of the positive's score and this score.

The search follows lists that clusters of anchors share. Anchors are clustered by angle around centres fitted on a bounded
sample (``SAMPLE`` distinct vectors; they decide what the search costs, not what it finds). For a cluster whose members lie
within an angle w of its centre, a row of length l at an angle v from the centre scores l cos(max(0, v - w)) at most
with a member of unit length. Rows are ordered by this bound once per cluster, and every member walks down the list until
what is left cannot reach its last kept score or its lowest score of interest: until then nothing is skipped, so results are whole. The list is
taken in stretches, each ``GROWTH`` times as long as the one before, whose ends are read off a histogram of the bounds; after each
one the members that are done leave, and rows that none of the others can use are not dealt any more. A stretch meets a
cluster in blocks of at most ``BLOCK_MEMBERS`` anchors and about ``CHUNK_ITEMS`` rows, and inside a block the walk goes on row by row.

Equal vectors with one label are one item that carries its smallest vec_ids, as many as one anchor can use, so a vector of a
third of all rows is met once; anchors with one vector and label are one member.

Rows without vec_id, label or vector, with a null in the vector, or so long that a score may not fit into 64 bits
(squared length of 2**62 or more) take no part. Shorter vectors count as if zeros followed. Repeated rows are rows of their own; of
several rows with an anchor's vec_id and label, the one that scores best counts as the anchor itself. An anchor with fewer
positives or negatives has what there is; an empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.common import map_batches, record_batch, ship_package
from forumlens.session import stage

POSITIVES = 5
NEGATIVES = 5
LOW, OF = 80, 100
#: Members of a cluster aimed at, clusters at most, distinct anchor vectors that fit the centres.
MEMBERS = 64
CLUSTERS = 64
SAMPLE = 4096
BLOCK_MEMBERS = 256
CHUNK_ITEMS = 4096
HEAD_ITEMS = 2048
GROWTH = 8
BINS = 2048

_ROUNDS = 12
_WALK_ITEMS = 512
_MOST = 2.0**62
_NEVER = -(1 << 62)
#: What rounding may take from a bound.
_SLACK = 1e-9


def pack(vector: list[int]) -> bytes:
    """The size of a component in bytes, then all components; equal vectors have equal bytes."""
    values = np.array(vector, np.int64)
    most = int(np.abs(values).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def unpack(packed: list[bytes]) -> np.ndarray:
    """A matrix of 64-bit integers, a vector each row, zeros at the end of shorter ones."""
    if len({(p[0], len(p)) for p in packed}) == 1:
        kind = np.dtype(f"i{packed[0][0]}")
        return np.frombuffer(b"".join(p[1:] for p in packed), kind).reshape(len(packed), -1).astype(np.int64)
    vectors = [np.frombuffer(p, f"i{p[0]}", offset=1) for p in packed]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _widen(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products, exact: by floating point where 53 bits hold every sum."""
    width = max(left.shape[1], right.shape[1])
    left, right = _widen(left, width), _widen(right, width)
    if float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


def _units(matrix: np.ndarray) -> np.ndarray:
    length = lengths(matrix)
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def fit_centres(sample: np.ndarray, clusters: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Centres of unit length: the farthest sample vectors in turn, then means of the nearest ones."""
    units = _units(sample)
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(clusters, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(rounds):
        of = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        empty = ~sums.any(axis=1)
        sums[empty] = centres[empty]
        centres = _units(sums)
    return centres


def _angles(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = max(matrix.shape[1], centres.shape[1])
    return np.arccos(np.clip(_widen(_units(matrix), width) @ _widen(centres, width).T, -1.0, 1.0))


def bounds(matrix: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """What a row scores at most with a member of unit length, for each row and cluster."""
    return lengths(matrix)[:, None] * np.cos(np.maximum(0.0, _angles(matrix, centres) - widths - _SLACK))


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(v) for v in batch.column(3).to_pylist()]
        length = [float(lengths(unpack([p]))[0]) for p in packed]
        yield record_batch(vec_id=batch.column(0), label=batch.column(1), anchor=batch.column(2),
                           vector=pa.array(packed, pa.binary()), length=pa.array(length, pa.float64()))


def _place_members(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            angles = _angles(unpack(batch.column(1).to_pylist()), centres)
            cluster = angles.argmin(axis=1)
            yield record_batch(member=batch.column(0), vector=batch.column(1), label=batch.column(2), length=batch.column(3),
                               cluster=cluster.astype(np.int32), angle=angles[np.arange(len(cluster)), cluster])


def _bin(bound: np.ndarray, longest: float) -> np.ndarray:
    """Bins count down from the largest bound possible."""
    share = (longest - bound) / (2 * longest) if longest else np.zeros_like(bound)
    return np.clip((share * BINS).astype(np.int64), 0, BINS - 1)


def _bin_end(last: np.ndarray, longest: float) -> np.ndarray:
    """No item beyond these bins has a larger bound."""
    return np.where(last >= BINS - 1, -np.inf, longest - (last + 1) * (2 * longest) / BINS + _SLACK * (longest + 1))


def _count_bounds(batches: Iterator[pa.RecordBatch], centres: np.ndarray, widths: np.ndarray,
                  longest: float) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(centres), BINS), np.int64)
    for batch in batches:
        if batch.num_rows:
            bins = _bin(bounds(unpack(batch.column(0).to_pylist()), centres, widths), longest)
            for c in range(len(centres)):
                counts[c] += np.bincount(bins[:, c], minlength=BINS)
    cluster, place = np.nonzero(counts)
    yield record_batch(cluster=cluster.astype(np.int32), bin=place.astype(np.int32), n=counts[cluster, place])


def _deal_items(batches: Iterator[pa.RecordBatch], centres: np.ndarray, widths: np.ndarray, longest: float, begin: np.ndarray,
                end: np.ndarray, wanted: np.ndarray, blocks: np.ndarray, chunks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Copies of the items in bins [begin, end) of a cluster's list that a member may want, one for each block of its members."""
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column(1).to_pylist()
        matrix = unpack(packed)
        bound = bounds(matrix, centres, widths)
        bins = _bin(bound, longest)
        spread = np.array([zlib.crc32(p) for p in packed], np.int64)
        ids = batch.column(2)
        for c in np.flatnonzero(blocks).tolist():
            rows = np.flatnonzero((bins[:, c] >= begin[c]) & (bins[:, c] < end[c]) & (bound[:, c] >= wanted[c]))
            if not len(rows):
                continue
            take = pa.array(rows)
            for block in range(int(blocks[c])):
                yield record_batch(cluster=np.full(len(rows), c, np.int32), block=np.full(len(rows), block, np.int32),
                                   chunk=(spread[rows] % chunks[c]).astype(np.int32), label=batch.column(0).take(take),
                                   vector=batch.column(1).take(take), ids=ids.take(take), bound=bound[rows, c])


def _best(score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((vec_id, -score))[:k]
    return score[order], vec_id[order]


def _walk(requests: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """Every request walks down one chunk of its cluster's list, until the bounds rule out what is left."""
    empty = pa.table({"request": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
    if not requests.num_rows or not items.num_rows:
        return empty
    items = items.sort_by([("bound", "descending")])
    bound, item_label = items["bound"].to_numpy(), items["label"].to_numpy()
    ids = items["ids"].to_pylist()
    matrix = unpack(items["vector"].to_pylist())
    members, member_of = np.unique(requests["member"].to_numpy(), return_index=True)
    vectors = requests["vector"].take(pa.array(member_of)).to_pylist()
    row_of = np.searchsorted(members, requests["member"].to_numpy())
    column = {c: requests[c].to_numpy() for c in ("request", "label", "same", "low", "high", "length", "need")}
    need = column["need"].copy()
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(need)
    for begin in range(0, len(bound), _WALK_ITEMS):
        reach = bound[begin] * column["length"]
        going = np.flatnonzero(reach + np.abs(reach) * _SLACK + 1 >= need)
        if not len(going):
            break
        used, back = np.unique(row_of[going], return_inverse=True)
        part = scores(unpack([vectors[m] for m in used]), matrix[begin:begin + _WALK_ITEMS])
        labels = item_label[begin:begin + _WALK_ITEMS]
        for j, own in zip(going.tolist(), back.tolist()):
            score = part[own]
            hit = np.flatnonzero((score >= need[j]) & (score <= column["high"][j]) & ((labels == column["label"][j]) == column["same"][j]))
            if not len(hit):
                continue
            found = [ids[begin + i] for i in hit]
            kept[j] = _best(np.concatenate((kept[j][0], np.repeat(score[hit], [len(f) for f in found]))),
                            np.concatenate((kept[j][1], np.array([x for f in found for x in f], np.int64))), k)
            if len(kept[j][0]) == k:
                need[j] = max(need[j], kept[j][0][-1])
    sizes = [len(s) for s, _ in kept]
    return pa.table({"request": np.repeat(column["request"], sizes), "score": np.concatenate([s for s, _ in kept]),
                     "vec_id": np.concatenate([v for _, v in kept])})


def _first_rows(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first rows of each group; all but k leave a task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


class _Lists:
    """Items, centres and histogram of one search; walks for any table of requests."""

    def __init__(self, items: DataFrame, members: DataFrame, centres: np.ndarray):
        self.items, self.centres = items, centres
        self.widths, self.blocks = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in members.groupBy("cluster").agg(F.max("angle").alias("width"), F.count("*").alias("n")).collect():
            self.widths[r.cluster], self.blocks[r.cluster] = r.width, -(-r.n // BLOCK_MEMBERS)
        self.longest = items.agg(F.max("length")).first()[0] or 0.0
        counted = map_batches(items.select("vector"), partial(_count_bounds, centres=centres, widths=self.widths, longest=self.longest),
                              "cluster int, bin int, n long")
        self.counts = np.zeros((len(centres), BINS), np.int64)
        for r in counted.groupBy("cluster", "bin").agg(F.sum("n").alias("n")).collect():
            self.counts[r.cluster, r.bin] = r.n

    def block_of(self, member: Column, cluster: Column) -> Column:
        blocks = F.element_at(F.array(*(F.lit(max(1, int(b))) for b in self.blocks)), cluster + 1)
        return F.pmod(F.xxhash64(member), blocks).cast("int")

    def answer(self, requests: DataFrame, k: int) -> DataFrame:
        """(request, score, vec_id, rank) of each request, by rank from 1.

        ``requests`` (request, member, cluster, block, vector, length, label, same, low, high): the best k rows of the same
        or of another label whose score lies in [low, high].
        """
        total = np.cumsum(self.counts, axis=1)
        begin, found, waiting, size = np.zeros(len(self.centres), np.int64), None, requests.withColumn("need", F.col("low")), HEAD_ITEMS
        while True:
            end = np.array([np.searchsorted(t, size) for t in total]) + 1
            end = np.where(end >= BINS, BINS, end)
            waiting = stage(waiting)
            reach = {r.cluster: r for r in waiting.groupBy("cluster").agg(F.min(F.when(
                F.col("length") > 0, F.col("need") / F.col("length")).otherwise(F.lit(float("-inf")))).alias("least")).collect()}
            if not reach:
                break
            wanted = np.array([reach[c].least if c in reach else np.inf for c in range(len(self.centres))])
            wanted -= np.where(np.isfinite(wanted), np.abs(wanted) * _SLACK + 1, 0.0)
            blocks = np.where([c in reach for c in range(len(self.centres))], self.blocks, 0)
            chunks = np.array([max(1, -(-int(self.counts[c, begin[c]:end[c]].sum()) // CHUNK_ITEMS)) for c in range(len(blocks))])
            dealt = map_batches(self.items.select("label", "vector", "ids"), partial(
                _deal_items, centres=self.centres, widths=self.widths, longest=self.longest, begin=begin, end=end, wanted=wanted,
                blocks=blocks, chunks=chunks), "cluster int, block int, chunk int, label long, vector binary, ids array<long>, bound double")
            last_chunk = F.element_at(F.array(*(F.lit(x - 1) for x in chunks.tolist())), F.col("cluster") + 1).cast("int")
            asked = waiting.withColumn("chunk", F.explode(F.sequence(F.lit(0), last_chunk)))
            keys = ("cluster", "block", "chunk")
            new = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
                partial(_walk, k=k), "request long, score long, vec_id long")
            every = new if found is None else new.unionByName(found.drop("rank"))
            found = stage(_first_rows(every, ["request"], k, F.desc("score"), F.asc("vec_id")))
            if (end[list(reach)] >= BINS).all():
                break
            last = found.groupBy("request").agg(F.count("*").alias("n"), F.min("score").alias("last"))
            need = F.when(F.col("n") >= k, F.greatest("low", "last")).otherwise(F.col("low"))
            rest = F.element_at(F.array(*(F.lit(float(x)) for x in _bin_end(end - 1, self.longest))), F.col("cluster") + 1)
            waiting = (waiting.drop("need").join(last, "request", "left").withColumn("need", need)
                       .withColumn("rest", rest).where(F.col("rest") > float("-inf"))
                       .withColumn("reach", F.col("rest") * F.col("length"))
                       .where(F.col("reach") + F.abs("reach") * _SLACK + 1 >= F.col("need"))
                       .drop("n", "last", "rest", "reach"))
            begin, size = end, size * GROWTH
        return found


def _integers(vectors: DataFrame, anchor: Column) -> DataFrame:
    """(vec_id, label, anchor, vector, length) of the rows that take part; vectors packed."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<bigint>").alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
             & ~F.exists("vector", lambda x: x.isNull()))
    rows = rows.where(sound).where(square < _MOST)
    return map_batches(rows, _pack_rows, "vec_id long, label long, anchor boolean, vector binary, length double")


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, members: int = MEMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``vectors`` (vec_id, label, vector: array of integers); ``anchor`` tells which of its rows are anchors; ``members`` is the
    size of cluster aimed at.
    """
    ship_package(vectors.sparkSession)
    rows = stage(_integers(vectors, anchor))
    smallest = _first_rows(rows.select("vec_id", "label", "vector", "length"), ["label", "vector"], max(positives + 1, negatives),
                           F.asc("vec_id"))
    items = stage(smallest.groupBy("label", "vector").agg(F.first("length").alias("length"), F.sort_array(
        F.collect_list("vec_id")).alias("ids")))
    anchors = rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "vector", "length")
    distinct = stage(anchors.groupBy("label", "vector").agg(F.first("length").alias("length")).withColumn(
        "member", F.monotonically_increasing_id()))
    sample = [bytes(r.vector) for r in distinct.orderBy(F.md5("vector"), "label").limit(SAMPLE).select("vector").collect()]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    clusters = min(CLUSTERS, max(1, -(-distinct.count() // members)))
    centres = fit_centres(unpack(sample), clusters)
    placed = stage(map_batches(distinct.select("member", "vector", "label", "length"), partial(_place_members, centres=centres),
                               "member long, vector binary, label long, length double, cluster int, angle double"))
    lists = _Lists(items, placed, centres)
    placed = placed.withColumn("block", lists.block_of(F.col("member"), F.col("cluster"))).drop("angle")
    nearest = lists.answer(placed.select(
        F.col("member").alias("request"), "*", F.lit(True).alias("same"), F.lit(_NEVER).cast("bigint").alias("low"),
        F.lit(-_NEVER).cast("bigint").alias("high")), positives + 1)
    # one request for each score of a positive: what lies within its share is the same for equal scores
    levels = nearest.where("score >= 0").select(F.col("request").alias("member"), F.col("score").alias("high")).distinct()
    least = F.expr(f"({LOW}BD * high + {OF - 1}) div {OF}").cast("bigint")
    asked = stage(levels.join(placed, "member").select(
        "member", "high", "cluster", "block", "vector", "length", "label", F.lit(False).alias("same"), least.alias("low")).withColumn(
        "request", F.monotonically_increasing_id()))
    below = lists.answer(asked, negatives)
    if below is None:
        return vectors.sparkSession.createDataFrame([], schema)
    windows = below.join(asked.select("request", "member", "high"), "request").groupBy("member", "high").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives"))
    ranked = nearest.withColumnRenamed("request", "member").join(
        windows.withColumnRenamed("high", "score"), ["member", "score"], "left")
    lists_of = stage(ranked.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "negatives"))).alias("best"))
                     .join(placed.select("member", F.col("label").alias("l"), F.col("vector").alias("v")), "member"))
    own = anchors.join(lists_of, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")))
    itself = F.array_position(F.transform("best", lambda b: b["vec_id"]), F.col("anchor_id"))
    others = F.slice(F.filter("best", lambda b, k: k + 1 != F.col("itself")), 1, positives)
    each = own.withColumn("itself", itself).select("anchor_id", F.explode(others).alias("p"))
    return each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"),
                       F.explode("p.negatives").alias("n")).select(
        "anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.negative_id").alias("negative_id"), "positive_score",
        F.col("n.negative_score").alias("negative_score"))
