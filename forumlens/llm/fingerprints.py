"""Fingerprints of documents by consistent weighted sampling of their terms.

A text is the bag of its five-word shingles over normalised words (as in ``minhash``; a text of one to four words has one
shingle); a shingle weighs as much as it occurs. Each of ``SAMPLES`` samples draws, for every shingle x by hashes of x alone, two gamma(2, 1)
variables r and c and a uniform b. For the weight S let t = floor(ln S / r + b) and y = exp(r (t - b)); the sample is the
pair (x, t) with the smallest c / (y e^r). Two texts have the same sample with a probability that equals the generalised Jaccard
similarity of their bags: the sum of the smaller weights over the sum of the larger.

The draws are made of exponential variables E1, E2, E3: c = E1 + E2, r = E3 + ln(c / E1) and b = E3 / r have just these
distributions and are independent. Then c / (y e^r) = E1 exp(-r t), and for the weight 1, where t = 0, it is E1 itself,
an increasing function of one hash: among shingles that occur once the smallest hash wins, and no logarithm is taken.

A fingerprint is the hexadecimal text of all samples, 32 bits each; its likeness to another is the share of samples that
agree. Equal texts have equal fingerprints. Null and empty texts and texts without words have no shingle and the empty
fingerprint, which is wholly like itself (1) and unlike all others (0). Rows keep their number; other columns are left behind; an
empty table gives no rows. ``compare_next`` orders documents by doc_id (nulls last), then by a hash of the text; rows equal in both
are one document there.
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
from forumlens.llm.hashing import mix
from forumlens.llm.minhash import bag, shingles

SAMPLES = 128
#: Stretches of the order of documents, for each partition of a shuffle; sampled keys for each of them.
STRETCHES = 8
KEYS_PER_STRETCH = 64

_BLOCK_TERMS = 1 << 10
_CHUNK_BYTES = 1 << 20


def _salts(number: int) -> np.ndarray:
    return (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(number << 32)) >> np.uint64(32)).astype(np.uint32)


_SALTS = [_salts(n) for n in range(3)]


def _hashes(terms: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each term (64 bits) for each sample, a row each."""
    low, high = terms.astype(np.uint32), (terms >> np.uint64(32)).astype(np.uint32)
    h = low[:, None] ^ salts
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h += high[:, None]
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def _first_variable(hashes: np.ndarray) -> np.ndarray:
    return -np.log1p(-(hashes + 0.5) * 2.0**-32)


def _heavy(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of each sample over shingles of any weight, and the sample."""
    hashes = _hashes(terms, _SALTS[0])
    e1, e2, e3 = _first_variable(hashes), *(-np.log((_hashes(terms, s) + 0.5) * 2.0**-32) for s in _SALTS[1:])
    r = e3 + np.log((e1 + e2) / e1)
    t = np.floor((np.log(counts)[:, None] + e3) / r)
    value = e1 * np.exp(-r * t)
    best = value.argmin(axis=0)
    every = np.arange(SAMPLES)
    step = t[best, every].astype(np.uint64).astype(np.uint32)
    return value[best, every], hashes[best, every] + step * np.uint32(0x9E3779B1)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The samples of bags (distinct shingles, counts) that are not empty, a row each."""
    best = np.full((len(bags), SAMPLES), 0xFFFFFFFF, np.uint32)
    single = [terms[counts == 1] for terms, counts in bags]
    terms = np.concatenate(single) if single else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(bags)), [len(s) for s in single])
    for begin in range(0, len(terms), _BLOCK_TERMS):
        own = owner[begin:begin + _BLOCK_TERMS]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        least = np.minimum.reduceat(_hashes(terms[begin:begin + _BLOCK_TERMS], _SALTS[0]), starts, axis=0)
        best[own[starts]] = np.minimum(best[own[starts]], least)
    for k, (all_terms, counts) in enumerate(bags):
        many = np.flatnonzero(counts > 1)
        if not len(many):
            continue
        value = _first_variable(best[k]) if len(single[k]) else np.full(SAMPLES, np.inf)
        for begin in range(0, len(many), _BLOCK_TERMS):
            part = many[begin:begin + _BLOCK_TERMS]
            other, sample = _heavy(all_terms[part], counts[part])
            smaller = other < value
            value, best[k] = np.where(smaller, other, value), np.where(smaller, sample, best[k])
    return best


def fingerprints_of(texts: list[bytes]) -> list[bytes]:
    """The samples of each text as big-endian 32-bit numbers; nothing for a text without words."""
    out: list[bytes] = []
    while len(out) < len(texts):
        part, size = [], 0
        for text in texts[len(out):]:
            if part and size + len(text) > _CHUNK_BYTES:
                break
            part.append(text.translate(_NORMAL))
            size += len(text)
        bags = [bag(g) for g in shingles(part)]
        full = [k for k, (terms, _) in enumerate(bags) if len(terms)]
        found = [b""] * len(part)
        for k, samples in zip(full, signatures([bags[k] for k in full]).astype(">u4")):
            found[k] = samples.tobytes()
        out += found
    return out


def alike(left: bytes, right: bytes) -> float:
    """Share of samples that agree."""
    if not left or not right:
        return float(left == right)
    return float(np.mean(np.frombuffer(left, ">u4") == np.frombuffer(right, ">u4")))


def likeness(left: Column, right: Column) -> Column:
    """Share of samples that agree, of two columns of fingerprints."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)),
                           lambda k: F.substring(left, k * 8 + 1, 8) == F.substring(right, k * 8 + 1, 8)))
    return F.when((left == "") | (right == ""), (left == right).cast("double")).otherwise(same / F.lit(SAMPLES))


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints_of([t or b"" for t in batch.column(1).to_pylist()])
        yield record_batch(doc_id=batch.column(0), fingerprint=[f.hex() for f in found])


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of documents (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_batches(rows, _fingerprint, "doc_id long, fingerprint string")


def _order(doc_id: Column, tie: Column) -> Column:
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("bigint")).alias("id"), tie.alias("tie"))


def _firsts(keys: DataFrame) -> list[tuple]:
    """First keys of stretches of the order, the first of all to begin with; the others come from a bounded sample by hash."""
    n = max(1, STRETCHES * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = keys.distinct()
    size, first = distinct.agg(F.count("*"), F.min("key")).first()
    if not size:
        return []
    every = max(1, size // (KEYS_PER_STRETCH * n))
    sample = sorted(tuple(r.key) for r in distinct.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect())
    cuts = {sample[k * len(sample) // n] for k in range(1, n)} if sample else set()
    return sorted(cuts | {tuple(first)})


def _position(key: Column, firsts: list[tuple]) -> Column:
    """Number of the stretch of a key, found in two steps of about the square root of their number."""
    def literal(keys: list[tuple]) -> Column:
        return F.array(*(F.struct(F.lit(n).alias("none"), F.lit(i).cast("bigint").alias("id"), F.lit(t).cast("bigint").alias("tie"))
                         for n, i, t in keys))

    width = max(1, round(len(firsts) ** 0.5))
    groups = [firsts[k:k + width] for k in range(0, len(firsts), width)]
    group = F.size(F.filter(literal([g[0] for g in groups]), lambda x: x <= key)) - 1
    inside = F.size(F.filter(F.element_at(F.array(*(literal(g) for g in groups)), group + 1), lambda x: x <= key)) - 1
    return group * width + inside


def with_next(docs: DataFrame) -> DataFrame:
    """(stretch, extra, doc_id, tie, text), sorted in each task so that a document is followed by the next one.

    The order is cut into stretches at known keys. A stretch ends with a copy of the first document of the next one,
    marked as ``extra``, and the last stretch with the first document of all; texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("tie"),
                       F.col("text").cast("string").alias("text"))
    key = _order(F.col("doc_id"), F.col("tie"))
    firsts = _firsts(rows.select(key.alias("key")))
    if not firsts:
        return rows.select(F.lit(0).alias("stretch"), F.lit(False).alias("extra"), "*").limit(0)
    placed = rows.withColumn("at", _position(key, firsts))
    begins = F.array(*(F.struct(F.lit(n), F.lit(i).cast("bigint"), F.lit(t).cast("bigint")) for n, i, t in firsts))
    before = F.pmod(F.col("at") - 1, F.lit(len(firsts)))
    here = F.struct(F.col("at").alias("stretch"), F.lit(False).alias("extra"))
    there = F.struct(before.alias("stretch"), F.lit(True).alias("extra"))
    first = F.element_at(begins, F.col("at") + 1) == F.struct(key["none"], key["id"], key["tie"])
    dealt = placed.select(F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("p"), "doc_id", "tie", "text")
    return (dealt.select("p.stretch", "p.extra", "doc_id", "tie", "text").repartition("stretch")
            .sortWithinPartitions("stretch", "extra", F.col("doc_id").asc_nulls_last(), "tie"))


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters of the following text, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class _Walk:
    """Holds one document until the next one is known, and what is to be written of a batch."""

    def __init__(self):
        self.open: list | None = None  # stretch, doc_id, tie, text, how many rows, whether extra
        self.ready: list[tuple] = []

    def add(self, stretch, extra, doc_id, tie, text) -> None:
        last = self.open
        if last and last[0] == stretch and last[1:3] == [doc_id, tie] and last[5] == extra:
            last[4] += 1
            return
        if last and last[0] == stretch and not last[5]:
            self.ready.append((*last[1:5], text))
        self.open = [stretch, doc_id, tie, text, 1, extra]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk()
    for batch in batches:
        walk.ready = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), (t or "" for t in batch.column(4).to_pylist())):
            walk.add(*row)
        if not walk.ready:
            continue
        edited = [edited_text(text, following).encode() for _, _, text, _, following in walk.ready]
        # the document after this one is mostly in hand: its own row comes next
        chain = [walk.ready[0][2].encode()]
        place = []
        for _, _, text, _, following in walk.ready:
            if chain[-1] != text.encode():
                chain.append(text.encode())
            place.append(len(chain) - 1)
            chain.append(following.encode())
        found = fingerprints_of(chain + edited)
        columns: dict[str, list] = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                    "near_edited", "near_next")}
        for k, (doc_id, _, text, n, _) in enumerate(walk.ready):
            own, following, changed = found[place[k]], found[place[k] + 1], found[len(chain) + k]
            values = (doc_id, len(text), hashlib.sha256(edited[k]).hexdigest(), own.hex(), changed.hex(),
                      alike(own, changed), alike(own, following))
            for column, value in zip(columns.values(), values):
                column += [value] * n
        yield record_batch(**{c: pa.array(v, pa.int64()) if c in ("doc_id", "n_chars") else pa.array(
            v, pa.float64() if c.startswith("near") else pa.string()) for c, v in columns.items()})


def compare_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and how near they and the next document's are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); the edited text has its last
    half replaced by the beginning of the next document, and the next of the last document is the first.
    """
    return map_batches(with_next(docs), _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                  "edited_fingerprint string, near_edited double, near_next double")
