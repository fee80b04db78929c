import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.llm import fingerprints, minhash
from forumlens.llm.decontaminate import _NORMAL
from tests.llm.helpers import frame, odd_rows, prose, texts


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("most", [1, 2, 30])
def test_samples_agree_as_often_as_weighted_jaccard(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(0, most + 1, (2, 150))
    b = np.where(rng.random(150) < 0.5, a, b)
    bags, share = [], np.minimum(a, b).sum() / np.maximum(a, b).sum()
    for _ in range(200):
        terms = rng.integers(0, 1 << 63, 150).astype(np.uint64)
        bags += [(terms[a > 0], a[a > 0]), (terms[b > 0], b[b > 0])]
    found = fingerprints.signatures(bags)
    agree = (found[::2] == found[1::2]).mean()
    assert abs(agree - share) < 4 * (share * (1 - share) / (200 * fingerprints.SAMPLES)) ** 0.5


def test_samples_as_by_the_formulas():
    """The smallest c / (y e^r) over all shingles, from the gamma variables that the exponential ones make up."""
    rng = np.random.default_rng(9)
    terms, counts = rng.integers(0, 1 << 63, 30).astype(np.uint64), rng.integers(1, 5, 30)
    hashes = fingerprints._hashes(terms, fingerprints._SALTS[0])
    e1 = -np.log1p(-(hashes + 0.5) / 2**32)
    e2, e3 = (-np.log((fingerprints._hashes(terms, s) + 0.5) / 2**32) for s in fingerprints._SALTS[1:])
    c, r = e1 + e2, e3 + np.log((e1 + e2) / e1)
    b = e3 / r
    t = np.floor(np.log(counts)[:, None] / r + b)
    first = (c / (np.exp(r * (t - b)) * np.exp(r))).argmin(axis=0)
    every = np.arange(fingerprints.SAMPLES)
    want = hashes[first, every] + t[first, every].astype(np.uint32) * np.uint32(0x9E3779B1)
    assert (fingerprints.signatures([(terms, counts)])[0] == want).all()


def test_blocks_and_neighbours_change_nothing(monkeypatch):
    some = [prose(n, n).encode() for n in (0, 1, 3, 5, 90, 2000)] + [("again " * 50).encode(), prose(40).encode() * 3]
    together = fingerprints.fingerprints_of(some)
    assert [fingerprints.fingerprints_of([t])[0] for t in some] == together
    monkeypatch.setattr(fingerprints, "_BLOCK_TERMS", 7)
    assert fingerprints.fingerprints_of(some) == together
    assert together[0] == b"" and fingerprints.alike(b"", b"") == 1 and fingerprints.alike(together[1], b"") == 0


def test_fingerprint_of_every_row(spark):
    found = fingerprints.fingerprint(frame(spark, odd_rows()))
    want = [(i, fingerprints.fingerprints_of([t.encode()])[0].hex()) for i, t in texts(odd_rows())]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    both = found.alias("x").crossJoin(found.alias("y")).select(
        "x.fingerprint", F.col("y.fingerprint").alias("other"), fingerprints.likeness(F.col("x.fingerprint"), F.col("y.fingerprint")).alias("near"))
    for r in both.collect():
        assert r.near == fingerprints.alike(bytes.fromhex(r.fingerprint), bytes.fromhex(r.other))
    assert fingerprints.fingerprint(frame(spark, [])).collect() == []


@pytest.mark.parametrize("stretches", [1, 8])
def test_next_document_and_edits(spark, monkeypatch, stretches):
    monkeypatch.setattr(fingerprints, "STRETCHES", stretches)
    rows = [*odd_rows(), *((i, prose(30 + i % 50, i % 9)) for i in range(20, 90)), *((400, "hot one") for _ in range(60))]
    every = [(i is None, i or 0, t or "") for i, t in rows]
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for _, _, t in set(every)], "t string").select(
        "t", F.xxhash64("t").alias("h")).distinct().collect()}
    order = sorted(set(every), key=lambda r: (*r[:2], tie[r[2]]))
    want = []
    for k, (none, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed, other = fingerprints.fingerprints_of([t.encode() for t in (text, edited, following)])
        want += [(None if none else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), changed.hex(),
                  fingerprints.alike(own, changed), fingerprints.alike(own, other))] * every.count((none, i, text))
    found = fingerprints.compare_next(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_few_documents(spark):
    assert fingerprints.compare_next(frame(spark, [])).collect() == []
    only = fingerprints.compare_next(frame(spark, [(3, "one two three four")])).collect()
    assert [(r.n_chars, r.edited_sha256) for r in only] == [(18, hashlib.sha256(b"one two tone two t").hexdigest())]


def test_near_texts_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shingles = {r.doc_id: minhash.shingles([(r.text or "").encode().translate(_NORMAL)])[0].tolist() for r in docs.collect()}
    found = sorted(fingerprints.compare_next(docs).collect())
    errors = [r.near_next - jaccard(shingles[r.doc_id], shingles[s.doc_id]) for r, s in zip(found, [*found[1:], found[0]])]
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.01
