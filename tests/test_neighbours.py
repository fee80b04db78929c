import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.operators import neighbours, similarity
from tests.conftest import SMALL

SCHEMA = "id long, vector array<float>"


def exact(rows, k=5):
    """{query: {(sim, id), ...}} of the k best others, and the similarity of the last."""
    ids, matrix = [i for i, _ in rows], np.array([v for _, v in rows], float)
    length = np.linalg.norm(matrix, axis=1)
    sims = np.round(matrix @ matrix.T / np.outer(length, length), similarity.DIGITS)
    return {i: sorted((-sims[n, m], ids[m]) for m in range(len(ids)) if m != n)[:k] for n, i in enumerate(ids)}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def test_recall_and_share_of_rows_compared(spark, vectors):
    rows = [(r.id, r.vector) for r in vectors.collect()]
    index = neighbours.build(vectors)
    asked = vectors.where(F.col("id") % 10 == 0)
    found = {}
    for r in neighbours.search(index, asked).collect():
        found.setdefault(r.target, set()).add((-r.sim, r.id))
    best = exact(rows)
    recall = np.mean([len(found[q] & set(best[q])) / 5 for q in found])
    share = neighbours.candidates(index, asked).count() / (len(found) * len(rows))
    assert len(found) == 50 and recall >= 0.9 and share < 0.1


def test_what_is_found_is_ranked_exactly(spark, vectors):
    """Each query's result is what the exact search gives among the rows it is compared with."""
    index = neighbours.build(vectors)
    got = neighbours.search(index, vectors.where("id = 100")).orderBy("rank").collect()
    met = {r.id for r in neighbours.candidates(index, vectors.where("id = 100")).collect()}
    sims = similarity.recommend_by_vector(vectors, 100, k=499).collect()
    assert [(r.id, r.sim) for r in got] == [(r.id, r.sim) for r in sims if r.id in met][:5]


def test_copies_share_an_entry(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16)).round(3).tolist()
    rows = [(i, base[0] if i % 3 == 0 else base[i % 12]) for i in range(600)]
    index = neighbours.build(spark.createDataFrame(rows, SCHEMA))
    assert index.vectors.count() == 9 and index.codes.count() == 9 * index.shape.tables and index.copies.count() == 600
    got = {}
    for r in neighbours.search(index, spark.createDataFrame(rows[:9], SCHEMA)).orderBy("target", "rank").collect():
        got.setdefault(r.target, []).append((r.id, r.sim))
    assert got[0] == [(i, 1.0) for i in (3, 6, 9, 12, 15)] and got[3] == [(i, 1.0) for i in (0, 6, 9, 12, 15)]
    assert all([s for _, s in found] == [1.0] * 5 and target not in dict(found) for target, found in got.items())


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [2.0, 0.0]), (8, [0.0, 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = neighbours.search(neighbours.build(df), df, 2).collect()
    assert {(r.target, r.id, r.sim) for r in found if r.target in (1, 7)} == {(1, 7, 1.0), (7, 1, 1.0)}
    assert {r.target for r in found} <= {1, 4, 7, 8}
    empty = df.where("false")
    assert neighbours.search(neighbours.build(empty), empty).collect() == []


def test_stored_index(spark, vectors, tmp_path):
    index = neighbours.build(vectors)
    index.save(str(tmp_path / "index"))
    asked = vectors.where("id < 3")
    stored = neighbours.NeighbourIndex.load(spark, str(tmp_path / "index"))
    assert sorted(neighbours.search(stored, asked).collect()) == sorted(neighbours.search(index, asked).collect())


def test_small_blocks_find_what_a_join_of_buckets_finds(spark, vectors, monkeypatch):
    """Neither a row and its table nor a query and a row that it meets is a row of an index or of a shuffle."""
    index = neighbours.build(vectors)
    asked = vectors.where("id % 50 = 0")
    whole = neighbours.search(index, asked).collect()
    probes = index.shape.probes
    buckets = neighbours._buckets(neighbours._coded(asked, index.shape, index.dimensions, probes), index.shape, probes)
    met = buckets.withColumnRenamed("id", "query").join(index.codes, ["table", "code"]).groupBy("query", "id").count()
    for name, value in (("BLOCK_ROWS", 100), ("BLOCK_QUERIES", 4), ("STRETCH", 7), ("ENTRIES", 300)):
        monkeypatch.setattr(neighbours, name, value)
    assert index.coded.count() == vectors.count()  # not one row for each of the tables
    assert sorted(neighbours.search(index, asked).collect()) == sorted(whole)
    pairs = neighbours.candidates(index, asked)
    assert sorted(pairs.collect()) == sorted(met.where(F.col("count") >= index.shape.votes).select("query", "id").collect())
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
