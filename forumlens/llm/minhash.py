"""Near-duplicate documents by BagMinHash signatures of weighted Jaccard similarity.

A text is the bag of its five-word shingles over normalised words (as in ``decontaminate``); a text of one to four words has one
shingle. Texts with the same words are one node from the start. Signatures come from Poisson processes: the weights of a
shingle are cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; each interval that begins below the shingle's count
has a process whose rate is its width, seeded by shingle and interval alone. A point has a time, a weight inside the interval and
a register; it counts if its weight lies below the count. A register keeps its earliest point, so two bags agree in a
register with the probability of their weighted Jaccard similarity. Points come in order of time, and a process ends once
it is later than the latest register.

Registers are cut into bands; texts that agree in a band are candidates; at similarity 0.8 a pair shares no band with
probability 6e-5. In a bucket every member is first paired with the smallest only; pairs are verified by their exact
bag overlap and give first classes, so a bucket of copies costs as many pairs as members. In crowded buckets some members of the largest
class are then taken as centres in four more turns: what is like a part of the class soon joins it. Pairs of a bucket that are still
in different classes are then examined too, so no candidate link between classes is lost. Before a pair leaves a join, its
parity bitmaps must allow it: each element of a bag flips one bit, so the bits in which two bitmaps differ are no more than
the elements in which the bags differ; at similarity 0.8 these are a ninth of both sizes. The bitmap has four to eight
bits per element, so nearly every pair that passes is a link, and none is lost.

Null and empty texts have no shingle and are classes of their own. A class is named by its smallest doc_id (null if it has
none). Rows keep their number; rows with an equal id are told apart by their texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import map_batches, record_batch, text_key
from forumlens.llm.decontaminate import _NORMAL
from forumlens.llm.graph import components
from forumlens.llm.hashing import Pieces, mix
from forumlens.session import stage

SHINGLE_WORDS = 5
BANDS, BAND_REGISTERS = 32, 6
#: Members from which on a bucket is settled by more centres before the rest of it is compared pair by pair.
CROWD = 64
TURNS = 4
#: Members of a bucket's largest class that are centres in a turn.
CENTRES = 4
REGISTERS = BANDS * BAND_REGISTERS
#: Similarity of 0.8 or more, as a fraction.
LIKE, OF = 4, 5

_CHUNK_BYTES = 1 << 20
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(_GAMMA) % (1 << 64))


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the shingles of each normalised text, in order."""
    codes = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.concatenate(([False], codes != 0x20, [False])).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    words = Pieces(codes).hashes(begin, end)
    stops = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.searchsorted(begin, stops)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = words[a:b]
        size = min(SHINGLE_WORDS, len(own))
        grams = np.zeros(len(own) - size + 1 if size else 0, np.uint64)
        for k in range(size):
            grams = mix(grams * _GAMMA + own[k:len(own) - size + 1 + k])
        out.append(grams)
    return out


def bag(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(grams, return_counts=True)


def numbered(grams: np.ndarray) -> np.ndarray:
    """The bag as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    ordered = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, int)
    occurrence = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return np.sort(mix(ordered + occurrence.astype(np.uint64) * _GAMMA))


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """A bitmap of a set in 64-bit words: a bit is on if an odd number of elements fall on it.

    The number of words is a power of two; a bitmap of half the words is the exclusive or of its halves.
    """
    bits = 64
    while bits < 4 * len(elements):
        bits *= 2
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").view(np.int64)


def _differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ, the longer one folded to the words of the shorter (half as many at least)."""
    words = F.least(F.size(a), F.size(b))

    def word(bitmap: Column, i: Column) -> Column:
        return F.when(F.size(bitmap) > words, F.get(bitmap, i).bitwiseXOR(F.get(bitmap, i + words))).otherwise(F.get(bitmap, i))

    return F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0).cast("bigint"),
                       lambda n, i: n + F.bit_count(word(a, i).bitwiseXOR(word(b, i))))


def _possible(a: Column, size_a: Column, b: Column, size_b: Column) -> Column:
    """Whether two bags may reach the similarity, by their sizes and bitmaps."""
    near = (F.least(size_a, size_b) * OF >= F.greatest(size_a, size_b) * LIKE)
    return F.when(near, _differing_bits(a, b) * (OF + LIKE) <= (size_a + size_b) * (OF - LIKE)).otherwise(False)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= LIKE * (len(a) + len(b) - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """The registers of non-empty bags, a row each: the times of the earliest points."""
    sizes = np.array([len(h) for h, _ in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    shingle, count = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64)
    parts = []
    level, low = 0, 0
    while True:
        chosen = np.flatnonzero(count > low)
        if not len(chosen):
            break
        width = max(low, 1)
        parts.append((owner[chosen], mix(shingle[chosen] + _step(level)), np.full(len(chosen), width),
                      count[chosen] - low))
        level, low = level + 1, low + width
    owner, seed, width, room = (np.concatenate(p) for p in zip(*parts))
    earliest = np.full(len(bags) * registers, np.inf)
    latest = np.full(len(bags), np.inf)
    time, point = np.zeros(len(owner)), 0
    while len(owner):
        draw = mix(seed + _step(point))
        place = mix(draw ^ _GAMMA)
        point += 1
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        going = time <= latest[owner]
        if not going.all():
            owner, seed, width, room, time, place = (x[going] for x in (owner, seed, width, room, time, place))
        register = ((place >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        weight = ((place & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = weight < room
        np.minimum.at(earliest, owner[counts] * registers + register[counts], time[counts])
        active = np.unique(owner)
        latest[active] = earliest.reshape(-1, registers)[active].max(axis=1)
    return earliest.reshape(-1, registers)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = batch.column(0), batch.column(1)
        texts = [(t or b"").translate(_NORMAL) for t in batch.column(2).to_pylist()]
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= _CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            part = texts[begin:end]
            grams = shingles(part)
            full = [k for k, g in enumerate(grams) if len(g)]
            contents, bands, bitmaps = [None] * len(part), [None] * len(part), [None] * len(part)
            if full:
                found = signatures([bag(grams[k]) for k in full])
                bits = mix(found.view(np.uint64))
                keys = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(BAND_REGISTERS):
                    keys = mix(keys * _GAMMA + bits.reshape(-1, BANDS, BAND_REGISTERS)[:, :, r])
                for row, k in enumerate(full):
                    contents[k] = hashlib.blake2b(b" ".join(part[k].split()), digest_size=16).digest()
                    bands[k], bitmaps[k] = keys[row].view(np.int64), parity_bits(numbered(grams[k]))
            yield record_batch(doc_id=ids.slice(begin, end - begin), tie=ties.slice(begin, end - begin),
                               content=pa.array(contents, pa.binary()), bands=pa.array(bands, pa.list_(pa.int64())),
                               size=np.array([len(g) for g in grams], np.int64),
                               bitmap=pa.array(bitmaps, pa.list_(pa.int64())))
            begin = end


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [numbered(shingles([(t or b"").translate(_NORMAL)])[0]).tobytes() for t in batch.column(1).to_pylist()]
        yield record_batch(content=batch.column(0), bag=pa.array(bags, pa.binary()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        like = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(left, right)]
        yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(like, pa.bool_()))


def _possible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow."""
    left = nodes.select(F.col("content").alias("a"), F.col("size").alias("size_a"), F.col("bitmap").alias("bitmap_a"))
    right = nodes.select(F.col("content").alias("r"), F.col("size").alias("size_b"), F.col("bitmap").alias("bitmap_b"))
    allowed = _possible(F.col("bitmap_a"), F.col("size_a"), F.col("bitmap_b"), F.col("size_b"))
    return pairs.join(left, "a").join(right, (F.col("b") == F.col("r")) & allowed).select("a", "b")


def _bags_of(needed: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(content, bag) of the contents in ``needed``, written; ``rows`` are all documents with their texts."""
    where = nodes.select("content", F.col("first.doc_id").alias("d"), F.col("first.tie").alias("t")).join(needed.distinct(), "content")
    texts = rows.join(where, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    return stage(map_batches(texts.select("content", "text"), _bags, "content binary, bag binary").dropDuplicates(["content"]))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table that reach the similarity."""
    both = pairs.join(bags.toDF("a", "left_bag"), "a").join(bags.toDF("b", "right_bag"), "b")
    return map_batches(both.select("a", "b", "left_bag", "right_bag"), _verify, "a binary, b binary")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table that reach the similarity, bags made anew."""
    return _verified(pairs, _bags_of(pairs.select(F.col("a").alias("content")).union(pairs.select("b")), nodes, rows))


def _root() -> Column:
    return F.coalesce(F.col("root"), F.col("content"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, content, root) of members (band, content) by classes (node, root)."""
    return members.join(found.withColumnRenamed("node", "content"), "content", "left").select("band", "content", _root().alias("root"))


def _stepped(placed: DataFrame, step: DataFrame) -> DataFrame:
    """Members with the roots (hi) of ``step`` replaced by smaller ones (lo)."""
    moved = placed.join(step, F.col("root") == F.col("hi"), "left")
    return moved.select("band", "content", F.coalesce("lo", "root").alias("root"))


def _settled(shared: DataFrame, links: DataFrame, nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members with their classes) after ``TURNS`` turns in which crowded buckets get more centres.

    In a turn ``CENTRES`` members of the largest class of each bucket of ``CROWD`` members or more and two classes or more meet all
    members outside that class. Classes joined by the new links are renamed one step further each turn.
    """
    every = stage(_placed(shared.select("band", "content"), stage(components(links))))
    left, bags = every, None
    for turn in range(TURNS):
        picks = [f"pick{k}" for k in range(CENTRES)]
        sizes = left.groupBy("band", "root").agg(F.count("*").alias("n"), *(
            F.min(F.struct(F.xxhash64("content", F.lit(turn * CENTRES + k)).alias("order"), "content")).alias(c)
            for k, c in enumerate(picks)))
        mixed = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("classes"),
                                          F.max(F.struct("n", "root", *picks)).alias("largest"))
        mixed = stage(mixed.where((F.col("classes") > 1) & (F.col("n") >= CROWD)).select(
            "band", F.col("largest.root").alias("own"),
            F.array_distinct(F.array(*(F.col(f"largest.{c}.content") for c in picks))).alias("centres")))
        left = stage(left.join(mixed, "band").select("band", "content", "root", "centres", "own"))
        if not left.take(1):
            break
        if bags is None:
            bags = _bags_of(left.select("content"), nodes, rows)
        ray = left.where(F.col("root") != F.col("own")).select(F.explode("centres").alias("a"), F.col("content").alias("b"))
        more = stage(_verified(stage(_possible_pairs(ray.distinct(), nodes)), bags))
        links = links.union(more)
        named = stage(left.select("content", "root").distinct())
        ends = more.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").where(F.col("x") != F.col("y"))
        step = stage(ends.groupBy(F.greatest("x", "y").alias("hi")).agg(F.min(F.least("x", "y")).alias("lo")))
        left, every = stage(_stepped(left, step)), stage(_stepped(every, step))
    return links, every


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, class_id, kept) of every row of documents (doc_id, text).

    ``kept`` marks the row that stays: the one with the class's smallest doc_id (ties by a hash of the text). Rows that
    are equal in both are equal here.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("tie"),
                       F.col("text").cast("binary").alias("text"))
    encoded = stage(map_batches(rows, _encode, "doc_id long, tie long, content binary, bands array<long>, size long, "
                                               "bitmap array<long>"))
    full = encoded.where(F.col("content").isNotNull())
    firsts = full.groupBy(F.col("content").alias("c")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"))
    # equal contents have equal signatures: those of the first row stand for all
    same = ((F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("tie") == F.col("first.tie")))
    nodes = stage(full.join(firsts, same).select("content", "first", "bands", "size", "bitmap").dropDuplicates(["content"]))
    members = nodes.select("content", F.explode("bands").alias("band"))
    buckets = stage(members.groupBy("band").agg(F.min("content").alias("low"), F.max("content").alias("high"))
                    .where(F.col("low") != F.col("high")).select("band", "low"))
    shared = stage(members.join(buckets, "band"))
    star = shared.select(F.col("low").alias("a"), F.col("content").alias("b")).where(F.col("a") != F.col("b")).distinct()
    links = stage(_links(stage(_possible_pairs(star, nodes)), nodes, rows))
    links, placed = _settled(shared, links, nodes, rows)
    # what is left of a bucket: pairs of members in different classes
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y"))
    placed = placed.join(stage(mixed.select("band").join(buckets, "band")), "band").where(F.col("content") != F.col("low")).drop("low")
    inner = stage(placed.join(nodes.select("content", "size", "bitmap"), "content"))
    other = inner.toDF(*(f"{c}_2" for c in inner.columns))
    apart = ((F.col("band") == F.col("band_2")) & (F.col("content") < F.col("content_2")) & (F.col("root") != F.col("root_2"))
             & _possible(F.col("bitmap"), F.col("size"), F.col("bitmap_2"), F.col("size_2")))
    rest = stage(inner.join(other, apart).select(F.col("content").alias("a"), F.col("content_2").alias("b")).distinct())
    more = stage(_links(rest, nodes, rows))
    found = stage(components(links.union(more)))
    named = stage(nodes.join(found.withColumnRenamed("node", "content"), "content", "left").select(
        "content", "first", _root().alias("root")))
    heads = stage(named.groupBy("root").agg(F.min("first").alias("head")))
    # a class whose ids are all null has no name
    named = stage(named.join(heads, "root").select(F.col("content"), "head"))
    out = encoded.select("doc_id", "tie", "content").join(named, "content", "left")
    alone = F.col("content").isNull()
    return out.select(
        "doc_id", "tie", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie")))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, with all their columns; rows without words stay.

    Of rows that are equal in doc_id and text, one stays unless they have no words.
    """
    found = stage(classes(docs).groupBy("doc_id", "tie").agg(F.first("kept").alias("kept"), F.count("*").alias("n")))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.withColumn("d", F.col("row.doc_id").cast("bigint")).withColumn("t", text_key(F.col("row.text")))

    def of(keys: DataFrame) -> DataFrame:
        return row.join(keys, row["d"].eqNullSafe(keys["doc_id"]) & (row["t"] == keys["tie"]), "left_semi")

    kept = found.where("kept")
    single = of(kept.where("n = 1")).select("row.*")
    repeated = of(kept.where("n > 1"))
    wordless = F.length(F.regexp_replace(F.coalesce(F.col("row.text"), F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "")) == 0
    return single.unionByName(repeated.where(wordless).select("row.*")).unionByName(
        repeated.where(~wordless).dropDuplicates(["d", "t"]).select("row.*"))
