import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.llm import periodic_runs, queries
from tests.llm.helpers import frame, odd_rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every run, from the longest stretch of every lag at every place; the smallest lag of a stretch is its period."""
    found = {}
    for lag in range(1, len(words) // 4 + 1):
        at = 0
        while at + lag < len(words):
            end = at
            while end + lag < len(words) and words[end] == words[end + lag]:
                end += 1
            if end - at + lag >= max(6, 4 * lag):
                found.setdefault((at, end - at + lag), lag)
            at = max(end, at + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def cut(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcde"), max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    words = [w for piece, times in pieces for w in piece * times]
    found, sizes = periodic_runs.runs_of([" ".join(words).encode(), b"", b"a a a a a a"])
    assert found == [brute(words), [], [(0, 6, 1)]]
    assert sizes.tolist() == [len(words), 0, 6]


def test_runs_meet_and_hold_others():
    for text in ("a b " * 9 + "a b c " * 5, "a a a a a a b " * 5, "x " + "a b c d e " * 4 + "a b c d", "a b c " * 3, "ab " * 5,
                 "a " * 400 + "b " + "a " * 399 + "b " + "a " * 300):
        assert periodic_runs.runs_of([text.encode()])[0] == [brute(text.split())]


def test_long_texts_of_few_words():
    found, _ = periodic_runs.runs_of([("a " * 200_000).encode(), (" ".join(str(i % 7001) for i in range(100_000))).encode()])
    assert found == [[(0, 200_000, 1)], [(0, 100_000, 7001)]]


def test_rows_of_every_kind(spark):
    rows = [*odd_rows(), (10, "\x1c a a " * 8), (11, "é 中 " * 6 + "\t\n" + "é 中 " * 2), (None, "a " * 7)]
    found = periodic_runs.find(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    want = []
    for i, t in texts(rows):
        words = WORD.findall(t)
        runs = brute(words)
        want.append((i, len(words), runs, cut(words, runs)))
    key = str
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=key) == sorted(want, key=key)
    assert periodic_runs.find(frame(spark, [])).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want[r.doc_id] = (len(runs), *best, best[1] and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (
            "".join(f"{s},{m},{q}\n" for s, m, q in runs), cut(words, runs))))
    found = queries.op11_periodic_runs(spark, sf_dir)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 10


def test_planted_repeats_of_odd_rows(spark):
    rows = [(None, "a b"), (30, None), (30, ""), *((i, " ".join(f"w{k}" for k in range(40))) for i in range(40))]
    found = queries._with_repeats(frame(spark, rows)).collect()
    for r in found:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.text:
            g = zlib.crc32(str(r.doc_id).encode()) // 10
            a = g % 40
            p = 1 + (40 - a) // (3 + g % 8)
            assert r.text.split() == [f"w{k if k < a else a + (k - a) % p}" for k in range(40)]
        else:
            assert (r.doc_id, r.text) in rows
    assert len(found) == len(rows)
