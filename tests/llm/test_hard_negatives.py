import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.llm import hard_negatives, queries

SCHEMA = "vec_id long, label long, vector array<long>, member string, score string, rank string, cluster string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, is_anchor, positives=5, negatives=5):
    rows = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and None not in v]
    out = []
    for k, (i, label, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        def score(w):
            return sum(a * b for a, b in zip(v, w))
        ranked = sorted(((-score(w), j, other) for n, (j, other, w) in enumerate(rows) if n != k))
        for s, j, _ in [r for r in ranked if r[2] == label][:positives]:
            inside = [r for r in ranked if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(i, j, n + 1, m, -s, -t) for n, (t, m, _) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, **options):
    return sorted(map(tuple, hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, **options).collect()))


@pytest.mark.parametrize("kind", ["near", "ties", "long"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "HEAD_ITEMS", 40)
    monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    monkeypatch.setattr(hard_negatives, "CHUNK_ITEMS", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK_MEMBERS", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 100
    scale = {"near": 1, "ties": 0.02, "long": 2.0**22}[kind]
    rows = [(i, int(rng.integers(4)), [int(x) for x in np.floor(scale * (centres[i % 8] + rng.normal(size=6) * 25))]) for i in range(500)]
    assert found(spark, rows, members=6) == brute(rows, lambda i: i % 10 == 0)


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [int(x) for x in rng.integers(-9, 9, 4)]) for i in range(60)]
    rows += [(100, 0, None), (110, None, [1, 2, 3, 4]), (None, 1, [5, 5, 5, 5]), (120, 1, [1, None, 3, 4]), (130, 1, []),
             (140, 2, [0, 0, 0, 0]), (150, 0, [7]), (161, 2, [8, 8, 8, 8, 8, 8]), (170, 50, [9, 9, 9, 9]), (7, 1, rows[7][2])]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    rows += [(180, 1, [2**31, 0, 0, 0]), (190, 1, [2**30, 2**30, 0, 5])]  # the first is too long to score
    assert found(spark, rows) == brute(rows[:-2] + rows[-1:], lambda i: i % 10 == 0)
    assert found(spark, []) == [] and found(spark, [(1, 1, [1])]) == [] and found(spark, [(10, 1, [1])]) == []


def test_one_vector_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2 if i % 3 else 1, [int(x) for x in rng.integers(-50, 50, 4)] if i % 3 else [40, 40, -40, 40]) for i in range(900)]
    assert found(spark, rows, members=8) == brute(rows, lambda i: i % 10 == 0)


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    anchors, items = rng.integers(-99, 99, (40, 8)), rng.integers(-99, 99, (300, 8))
    centres = hard_negatives.fit_centres(anchors, 5)
    angles = hard_negatives._angles(anchors, centres)
    of = angles.argmin(axis=1)
    widths = np.array([angles[of == c, c].max(initial=0) for c in range(5)])
    bound = hard_negatives.bounds(items, centres, widths)
    reach = bound[:, of].T * hard_negatives.lengths(anchors)[:, None]
    assert (hard_negatives.scores(anchors, items) <= reach * (1 + 1e-9)).all()
    bins = hard_negatives._bin(bound, bound.max())
    assert (np.sort(bound.ravel())[::-1] == bound.ravel()[np.lexsort((-bound.ravel(), bins.ravel()))]).all()


def test_odd_values_in_the_table(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 4, [0.01 * (i % 13), 0.5, -0.2]) for i in range(210)]
    rows += [(300, 1, [nan, 0.1, 0.1]), (400, 1, [inf, 0.1, 0.1]), (500, None, [0.1, 0.1, 0.1]), (600, 2, None), (700, 3, [0.1, None, 0.2])]
    spark.createDataFrame(rows, "vec_id long, embedding_label int, embedding array<float>").withColumnRenamed(
        "embedding_label", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows[:210]]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, str(tmp_path)).collect())) == brute(whole, lambda i: i % 100 == 0)
