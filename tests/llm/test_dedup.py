import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.llm import graph, line_dedup, minhash
from forumlens.llm.decontaminate import words
from tests.llm.helpers import CLASHES, frame, odd_rows, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abé中", max_size=12), st.text("abé中", max_size=12), st.integers(0, 5)), max_size=6))
def test_banded_distances(pairs):
    left, right, limit = ([p[k] for p in pairs] for k in range(3))
    for a, b, k, got in zip(left, right, limit, line_dedup.edit_distances(left, right, np.array(limit, np.int64))):
        assert got == distance(a, b) if distance(a, b) <= k else got > k


def order(row):
    number, text = row
    return number is None, number or 0, text


def brute_lines(rows):
    """{row: (lines, links, removed places)} by comparing all lines; ``rows`` have ids that tell texts apart."""
    first, lines = {}, {}
    for row in sorted(set(rows), key=order):
        lines[row] = line_dedup.lines_of(row[1])
        for k, s in lines[row]:
            first.setdefault(s, (order(row), k))
    links, late = Counter(), set()
    for a in first:
        for b in first:
            if a < b and 0 < distance(a, b) <= min(len(a), len(b)) // 16:
                links.update((a, b))
                late.add(max(a, b, key=first.get))
    return {row: (len(found), sum(links[s] for _, s in found),
                  [k for k, s in found if first[s] != (order(row), k) or s in late]) for row, found in lines.items()}


def line_rows():
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["sun", "moon", "sea", "ice", "étoile"]) for _ in range(n)) for n in (1, 2, 4, 5, 7, 9, 12, 20)]

    def changed(line):
        chars = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice([[], ["q"], [chars[at], "w"]])
        return "".join(chars)

    return [(k, "\n".join(changed(rng.choice(lines)) for _ in range(rng.randint(0, 6)))) for k in range(60)]


def test_lines_against_all_pairs(spark):
    rows = line_rows() + [(70, "\n \n" + prose(9) + "\n\n" + prose(9) + "\n"), (None, prose(9)), (71, "")]
    cleaned = line_dedup.remove_lines(frame(spark, rows)).collect()
    expected = brute_lines(rows)
    decided = Counter((r["doc_id"], r["n_lines"], r["n_links"], tuple(r["removed"])) for r in line_dedup.decide(frame(spark, rows)).collect())
    assert decided == Counter((i, n, k, tuple(gone)) for (i, _), (n, k, gone) in expected.items())
    left = Counter((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)) for (i, t), (_, _, gone) in expected.items())
    assert Counter(r[:2] for r in cleaned) == left
    assert all(r["n_chars"] == len(r["text"]) and r["tie"] == "tie" for r in cleaned)


def test_edits_grow_with_the_length(spark):
    rng = random.Random(7)
    lines = []
    for n, edits in ((40, (2, 3)), (96, (3, 6, 7)), (200, (3, 11, 12, 13)), (650, (9, 40, 41)), (1200, (50, 75, 76))):
        base = "".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "."
        lines.append(base)
        for k in edits:  # dealt evenly, so that what is unchanged is as short as it can be
            chars = list(base)
            for at in range(k):
                chars[(2 * at + 1) * n // (2 * k)] = "X"
            lines.append("".join(chars))
    rows = [(i, line) for i, line in enumerate(lines)]
    links = Counter()
    for a in lines:
        for b in lines:
            if a < b and 0 < line_dedup.edit_distances([a], [b], np.array([min(len(a), len(b)) // 16]))[0] <= min(len(a), len(b)) // 16:
                links.update((a, b))
    got = {r["doc_id"]: (r["n_links"], len(r["removed"])) for r in line_dedup.decide(frame(spark, rows), max_edits=None).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: links[line] for i, line in rows}
    assert sum(links.values()) >= 2 * 10 and sum(gone for _, gone in got.values()) >= 10  # ten of them lie within the rate of their first line


@settings(max_examples=300, deadline=None)
@given(st.text("abé中", max_size=30), st.text("abé中", max_size=30), st.integers(0, 40))
def test_band_of_one_pair(a, b, k):
    short, long = sorted((a, b), key=len)
    got = line_dedup._band(short, long, k) if len(long) - len(short) <= k else k + 1
    assert got == distance(a, b) if distance(a, b) <= k else got > k


def apart(a, b, at, by):
    """Whether keys of two lines agree as the join demands, with the first line's segments."""
    la, ka, oa, fa, ea = at
    _, kb, _, fb, eb = by
    k, longer = len(a) // 16, len(b) - len(a)
    if not 0 <= longer <= k:
        return False
    for x, own, f, e in zip(ka, oa, fa, ea):
        for y, g, h in zip(kb, fb, eb):
            if own and x == y and f - h <= k and g - e <= k:
                i = ((f + 1) * (k + 1) - 1) // len(a)
                if not (f == e and g == h) or (abs(g - f) <= i and abs(longer - (g - f)) <= k - i):
                    return True
    return False


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_every_pair_within_the_rate_meets(data):
    """Random edits of random lines: one segment's key is always among the other line's keys, at a place that is possible."""
    letters = data.draw(st.sampled_from(["ab", "abcdefgh ", "a"]))
    a = data.draw(st.text(letters, min_size=16, max_size=150))
    b = list(a)
    for _ in range(data.draw(st.integers(1, len(a) // 16))):
        at = data.draw(st.integers(0, len(b) - 1))
        b[at:at + 1] = data.draw(st.sampled_from([[], ["X"], [b[at], "Y"], ["a", b[at]]]))
    short, long = sorted((a, "".join(b)), key=len)
    if short != long and len(short) >= 16 and 0 < distance(short, long) <= len(short) // 16:
        counts = np.zeros(1 << 20, np.uint16)
        assert apart(short, long, line_dedup.join_keys([short], counts), line_dedup.join_keys([long], counts))
    one = line_dedup.join_keys([a], np.zeros(1 << 20, np.uint16))
    two = line_dedup.join_keys(["filler of a line " * 3, a, "another"], np.zeros(1 << 20, np.uint16))
    assert [x[two[0] == 1].tolist() for x in two[1:]] == [x.tolist() for x in one[1:]]


def test_keys_are_dealt_once(spark, monkeypatch):
    staged, stage = [], line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df: staged.append(df) or stage(df))
    line_dedup.decide(frame(spark, line_rows())).collect()
    candidates = next(df for df in staged if df.columns == ["ref_a", "ref_b"])
    assert candidates._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_crowded_keys_meet_in_several_parts():
    lines = sorted({line for _, text in line_rows() for _, line in line_dedup.lines_of(text) if len(line) >= 16})
    ids, lengths = [line_dedup.line_id(line) for line in lines], np.array([len(line) for line in lines])
    refs = line_dedup.references(ids, lines)

    def met(count, every, n_parts):
        keys = line_dedup.join_keys(lines, np.full(1 << 20, count, np.uint16))
        dealt = pa.Table.from_batches([line_dedup._dealt_keys(refs, lengths, keys, every, n_parts)] * 2)  # twice, as by two tasks
        found = set()
        for part in set(dealt["part"].to_pylist()):
            of_part = line_dedup._meet(None)(dealt.filter(pc.equal(dealt["part"], part)))
            found |= set(zip(of_part["ref_a"].to_pylist(), of_part["ref_b"].to_pylist()))
        return found

    every_one = met(1, 1, 1)
    assert len(every_one) > 100 and met(1, 1, 7) == every_one and met((1 << 15) - 1, 64, 7) == every_one
    alike = {tuple(sorted((int(refs[i]), int(refs[j])))) for i, a in enumerate(lines) for j, b in enumerate(lines)
             if i < j and refs[i] != refs[j] and distance(a, b) <= min(len(a), len(b)) // 16}
    assert alike and alike <= every_one


def test_odd_documents_keep_their_rows(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    decided = line_dedup.decide(df).collect()
    assert Counter(r["doc_id"] for r in decided) == Counter(i for i, _ in rows)
    assert [r["removed"] for r in decided if r["doc_id"] == 1] == [[], []]      # equal rows are one document
    assert [r["removed"] for r in decided if r["doc_id"] == 2] == [[0]]
    cleaned = line_dedup.remove_lines(df)
    assert cleaned.schema.names == df.schema.names and cleaned.count() == len(rows)
    assert cleaned.where("doc_id = 3").first()["text"] is None
    left = Counter(r["doc_id"] for r in line_dedup.remove_lines(df, drop_emptied=True).collect())
    assert left == Counter(i for i, _ in rows) - Counter([2])
    assert line_dedup.decide(df.where("false")).count() == 0 and line_dedup.remove_lines(df.where("false")).count() == 0


def bag(text):
    w = words(text.encode())
    n = min(5, len(w))
    return Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else None


def like(a, b):
    return 5 * (a & b).total() >= 4 * (a | b).total()


def brute_classes(rows):
    """Class names, the smallest id of each component; ids differ."""
    root = {i: i for i, _ in rows}
    bags = {i: bag(t or "") for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in bags if bags[i]]
    for a in ids:
        for b in ids:
            if a < b and like(bags[a], bags[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_copies():
    rng = random.Random(5)
    rows, base = [], prose(120).split()
    for k in range(150):  # one text with one to many words changed: some pairs are alike, some only by way of others
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    rows += [(200 + k, prose(30, 1000 + 50 * k)) for k in range(40)]
    rows += [(300, "one two"), (301, "One, two!"), (302, "a a a a a a a a a b"), (303, "a a a a a a a a a a b"), (304, None), (305, "")]
    return rows


def test_classes_against_all_pairs(spark):
    rows = near_copies()
    got = {r["doc_id"]: r for r in minhash.classes(frame(spark, rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == brute_classes(rows)
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())


def test_crowded_buckets_are_settled_by_centres(spark, monkeypatch):
    """A family whose smallest member is unlike most others: classes as before, and few pairs are left to compare one by one."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), 1 if i % 3 else 6):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    for crowd in (2, 1000):
        monkeypatch.setattr(minhash, "CROWD", crowd)
        got = {r["doc_id"]: r["class_id"] for r in minhash.classes(frame(spark, rows)).collect()}
        assert got == brute_classes(rows)
    assert 20 < len(set(got.values())) < 40  # the strongly changed ones are apart


def test_members_near_a_part_of_the_largest_class_join_it_by_centres(spark, monkeypatch):
    """Texts with five changes are like those with one only: hardly a pair of them is left to the comparison pair by pair."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        text = [f"w{k}" for k in range(300)]
        for at in rng.sample(range(300), 1 if i < 30 else 3 if i < 120 else 5):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
    compared, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda pairs, *more: (compared.append(pairs.count()), links(pairs, *more))[1])
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 1
    assert compared[-1] < len(rows)


def test_one_of_each_class_stays(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    kept = minhash.keep_one(df)
    assert kept.schema == df.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1 and ids[4] == 2 and ids[5] == 2 and ids[None] == 2
    assert all(tuple(r[c] for c in CLASHES) == CLASHES for r in kept.collect())
    assert minhash.keep_one(df.where("false")).count() == 0 and minhash.classes(df.where("false")).count() == 0


def test_signatures_agree_as_often_as_bags(spark):
    rng = np.random.default_rng(2)
    for share, weight in ((0.9, 1), (0.5, 3), (0.2, 9)):
        common = rng.integers(0, 2**63, 200).astype(np.uint64)
        a = np.concatenate((np.repeat(common, weight), rng.integers(0, 2**63, 40).astype(np.uint64)))
        b = np.concatenate((np.repeat(common[: int(200 * share)], weight), rng.integers(0, 2**63, 60).astype(np.uint64)))
        x, y = Counter(a.tolist()), Counter(b.tolist())
        expected = (x & y).total() / (x | y).total()
        first, second = minhash.signatures([minhash.bag(a), minhash.bag(b)], 4096)
        assert abs((first == second).mean() - expected) < 5 * (expected * (1 - expected) / 4096) ** 0.5


def test_bitmaps_never_forbid_a_link(spark):
    rng = random.Random(1)
    pairs = []
    for n in (3, 15, 16, 17, 40, 128, 129, 600):
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = np.concatenate((a[: rng.randint(0, n)], np.array([rng.getrandbits(64) for _ in range(rng.randint(1, n))], np.uint64)))
        for x, y in ((a, a[: -(-n * 4 // 5)]), (a, b), (a, a)):
            pairs.append((minhash.parity_bits(np.sort(x)).tolist(), len(x), minhash.parity_bits(np.sort(y)).tolist(), len(y),
                          minhash.similar(np.sort(x), np.sort(y))))
    df = spark.createDataFrame(pairs, "a array<long>, m long, b array<long>, n long, alike boolean")
    found = df.select("alike", minhash._possible(df.a, df.m, df.b, df.n).alias("possible")).collect()
    assert all(r["possible"] for r in found if r["alike"]) and not all(r["possible"] for r in found)


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 105), (105, 103), (7, 7), (200, 201)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 105: 100, 103: 100, 200: 200, 201: 200}
    assert graph.components(df.where("false")).count() == 0


def test_references_are_made_for_a_whole_batch(monkeypatch):
    calls, references = [], line_dedup.references
    monkeypatch.setattr(line_dedup, "references", lambda ids, lines: calls.append(len(lines)) or references(ids, lines))
    texts = ["one line of words\n\n  another line of words ", None, "", "one line of words"]
    batch = pa.record_batch({"doc_id": [1, 2, None, 4], "tie": [5, 6, 7, 8], "text": texts})
    (listed,) = line_dedup._list_lines(iter([batch]))
    assert calls == [3] and listed.column("doc_id").to_pylist() == [1, 2, None, 4]
    rows = [[(x["place"], x["line"]) for x in row] for row in listed.column("lines").to_pylist()]
    assert rows == [[(k, line_dedup.line_id(s)) for k, s in line_dedup.lines_of(t or "")] for t in texts]
