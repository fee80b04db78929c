import math
import random
from collections import Counter

import numpy as np
import pytest

from forumlens.operators import similarity, tfidf, word_vectors
from forumlens.session import stage


def sentences(seed, n):
    """Two groups of words, each with its own company; "car" and "auto" keep the same company and never meet."""
    rng = random.Random(seed)
    road, sea = [f"road{k}" for k in range(12)], [f"sea{k}" for k in range(12)]
    out = []
    for i in range(n):
        company = road if i % 2 else sea
        words = [rng.choice(company) for _ in range(9)]
        words[rng.randrange(9)] = rng.choice(["car", "auto"] if i % 2 else ["ship", "boat"])
        out.append(words)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(sentences(3, 400))) + [(1000, []), (1001, None), (1002, ["rare"]), (1003, ["car"])]
    return stage(spark.createDataFrame(rows, "id long, words array<string>"))


def counted(rows, window, least):
    uses = Counter(w for words in rows for w in words)
    pairs = Counter()
    for words in rows:
        for i, a in enumerate(words):
            for b in words[i + 1:i + window]:
                pairs[a, b] += 1
                pairs[b, a] += 1
    return {k: n for k, n in pairs.items() if all(uses[w] >= least for w in k)}


@pytest.mark.parametrize("window, least", [(2, 1), (4, 5), (30, 80)])
def test_counts(spark, docs, window, least):
    rows = [r.words or [] for r in docs.collect()]
    got = {(r.word, r.context): r.n for r in word_vectors.cooccurrences(docs, window=window, min_count=least).collect()}
    assert got == counted(rows, window, least)


def matrix(docs):
    counts = counted([r.words or [] for r in docs.collect()], word_vectors.WINDOW, word_vectors.MIN_COUNT)
    names = sorted({a for a, _ in counts})
    total, all_pairs = Counter(), sum(counts.values())
    for (a, _), n in counts.items():
        total[a] += n
    m = np.zeros((len(names), len(names)))
    for (a, b), n in counts.items():
        m[names.index(a), names.index(b)] = max(0.0, math.log(n * all_pairs / (total[a] * total[b])))
    return names, m


def test_information_and_factors(spark, docs):
    names, m = matrix(docs)
    information = stage(word_vectors.mutual_information(stage(word_vectors.cooccurrences(docs))))
    got = {(r.word, r.context): r.x for r in information.collect()}
    assert all(abs(got.get((a, b), 0.0) - m[i, j]) < 1e-9 for i, a in enumerate(names) for j, b in enumerate(names))
    found = word_vectors.factorise(information, dimensions=6, rounds=300, tolerance=1e-12)
    vectors = {r.word: r.vector for r in found.vectors.collect()}
    got = np.array([vectors[n] for n in names])
    values, axes = np.linalg.eigh(m)
    order = np.argsort(-abs(values))[:3]  # the leading half of the block has settled
    assert np.linalg.norm(got, axis=0)[:3] ** 2 == pytest.approx(abs(values[order]), rel=1e-6)
    assert found.moved <= 1e-12 and found.rounds < 300
    for j, k in enumerate(order):
        assert abs(abs(got[:, j] @ axes[:, k]) - math.sqrt(abs(values[k]))) < 1e-4


def test_words_in_the_same_company_are_similar(spark, docs):
    found = word_vectors.learn(docs, dimensions=4)
    vectors = stage(found.vectors.withColumnRenamed("word", "id"))
    for word, other in (("car", "auto"), ("auto", "car"), ("ship", "boat"), ("boat", "ship")):
        near = {r.id for r in similarity.recommend_by_vector(vectors, word, k=13).collect()}
        company = "road" if word in ("car", "auto") else "sea"
        assert other in near and all(n.startswith(company) for n in near - {other})
    assert word_vectors.learn(docs, dimensions=4, rounds=1).moved == float("inf")


def test_no_posts(spark, docs):
    assert word_vectors.learn(docs.where("false"), dimensions=2).vectors.collect() == []


def test_pairs_are_made_once_and_null_words_make_none(spark, docs):
    plan = word_vectors.cooccurrences(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1
    odd = stage(spark.createDataFrame([(1, ["a", None, "b", "a", "a"]), (2, ["b"])], "id long, words array<string>"))
    got = {(r.word, r.context): r.n for r in word_vectors.cooccurrences(odd, window=3, min_count=1).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("a", "a"): 2}
    assert word_vectors.cooccurrences(odd, window=1, min_count=1).collect() == []


def test_pairs_move_as_arrays(spark, docs, monkeypatch):
    whole = {(r.word, r.context): r.n for r in word_vectors.cooccurrences(docs).collect()}
    monkeypatch.setattr(tfidf, "BLOCK_WORDS", 500)
    monkeypatch.setattr(word_vectors, "CELL_PAIRS", 900)
    monkeypatch.setattr(word_vectors, "STRETCH", 11)
    found = word_vectors.cooccurrences(docs)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # no pair is a row before it is named
    assert {(r.word, r.context): r.n for r in found.collect()} == whole
    twice = stage(docs.union(docs).union(docs.select(docs.id - docs.id, "words")))  # ids need not be unique
    assert {(r.word, r.context): r.n for r in word_vectors.cooccurrences(twice).collect()} == {k: 3 * n for k, n in whole.items()}


def test_vectors_learnt_in_cells_are_those_of_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(tfidf, "BLOCK_WORDS", 500)
    monkeypatch.setattr(word_vectors, "CELL_PAIRS", 900)
    monkeypatch.setattr(word_vectors, "STRETCH", 11)
    information = stage(word_vectors.mutual_information(stage(word_vectors.cooccurrences(docs))))
    monkeypatch.setattr(word_vectors, "mutual_information", None)  # no pair of words is a row on the way
    learnt = word_vectors.learn(docs, dimensions=4, rounds=3, tolerance=0.0)
    rows = word_vectors.factorise(information, dimensions=4, rounds=3, tolerance=0.0)
    got, expected = ({r.word: r.vector for r in found.vectors.collect()} for found in (learnt, rows))
    assert set(got) == set(expected) and all(got[w] == pytest.approx(expected[w], abs=1e-9) for w in expected)
    assert learnt.rounds == 3 and learnt.moved == pytest.approx(rows.moved, rel=1e-6) and not spark.catalog.listTables()
