import os
import random

from pyspark.sql import functions as F

from forumlens.operators import ingest, keywords
from forumlens.sources import store
from forumlens.sources.search import SearchSpec, filter_time_range, search_posts
from forumlens.streaming import keyed
from tests.helpers import rows

DOCS = "doc_id string, first string, born int, version long"
DAY = store.SECONDS_PER_DAY


def files(path):
    return {f"{folder}/{name}" for folder, _, names in os.walk(path) for name in names if name.startswith("part-")}


def test_latest_documents_with_replays_and_late_ones(spark, tmp_path):
    rng = random.Random(1)
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    docs = [(f"d{rng.randrange(40)}", rng.choice(["ann", None, "bob"]), rng.randrange(99), v) for v in range(300)]
    docs += [(None, "nobody", 1, 1000)]
    deliveries = [docs[100:200], docs[:100], docs[200:], docs[100:200], docs[:5], []]
    seen = []
    for batch in deliveries:
        seen += batch
        spark.createDataFrame(batch, DOCS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(DOCS).parquet(inbox)
        keyed.write_latest(stream, table, checkpoint, "doc_id", ("version",), buckets=8).awaitTermination()
        got = spark.read.parquet(table).select("doc_id", "first", "born", "version")
        want = ingest.latest_by_key(spark.createDataFrame(seen, DOCS).where("doc_id is not null"), "doc_id", [F.col("version")])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((r.doc_id, r.first, r.born, r.version) for r in want.collect()), key=str)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = str(tmp_path / "table")
    every = spark.createDataFrame([(f"d{i}", "ann", i, 1) for i in range(100)], DOCS)
    keyed.put_latest(every, table, str(tmp_path / "p0"), "doc_id", ("version",), buckets=16)
    before = files(table)
    one = spark.createDataFrame([("d7", "eve", 7, 2)], DOCS)
    keyed.put_latest(one, table, str(tmp_path / "p1"), "doc_id", ("version",), buckets=16)
    after = files(table)
    bucket = spark.createDataFrame([("d7",)], "doc_id string").select(keyed.bucket_of("doc_id", 16).alias("b")).first().b
    changed = before ^ after
    assert changed and all(f"/bucket={bucket}/" in f for f in changed)
    assert spark.read.parquet(table).count() == 100 and spark.read.parquet(table).where("doc_id = 'd7'").first().first == "eve"


def test_a_batch_that_was_lost_while_it_was_put_in_place(spark, tmp_path):
    table, pending = str(tmp_path / "table"), str(tmp_path / "pending")
    keyed.put_latest(spark.createDataFrame([("a", "ann", 1, 1), ("b", "bob", 1, 1)], DOCS), table, pending, "doc_id", ("version",), 1)
    new = spark.createDataFrame([("b", "bea", 2, 2)], DOCS)
    keyed.put_latest(new, table, f"{pending}1", "doc_id", ("version",), 1)
    spark.createDataFrame([("b", "half", 0, 0)], DOCS).withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(table)
    keyed.put_latest(new, table, f"{pending}1", "doc_id", ("version",), 1)  # the same batch again
    assert rows(spark.read.parquet(table).select("doc_id", "first")) == [("a", "ann"), ("b", "bea")]


def posts(spark):
    data = [(i, "brain" if i % 2 else "sea", None if i % 11 == 0 else f"{i % 3}", 10 * DAY + 5000 * i) for i in range(100)]
    df = spark.createDataFrame(data, "id long, title string, subreddit string, created_utc long")
    return df.withColumn("created_time", F.timestamp_seconds("created_utc"))


def test_stored_posts_are_pruned_by_day_and_channel(spark, tmp_path):
    path = str(tmp_path / "posts")
    store.write_posts(posts(spark), path)
    stored = store.read_posts(spark, path)
    assert rows(stored.select("id", "subreddit").na.fill("none")) == rows(posts(spark).select("id", "subreddit").na.fill("none"))
    spec = SearchSpec(subreddit="1", after=11 * DAY + 100, before=12 * DAY + 200, n_posts=100)
    found = store.search_stored(stored, spec)
    assert rows(found.select("id")) == rows(search_posts(posts(spark), spec).select("id")) and found.count() > 3
    scan = found._jdf.queryExecution().executedPlan().toString()
    filters = scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "day" in filters and "subreddit" in filters
    read = {r.file for r in store.search_stored(stored.withColumn("file", F.input_file_name()), spec).collect()}
    assert all("/day=1970-01-12/" in f or "/day=1970-01-13/" in f for f in read)


def test_days_of_a_small_table_prune_while_the_query_runs(spark, tmp_path):
    path = str(tmp_path / "posts")
    store.write_posts(posts(spark), path)
    stored = store.read_posts(spark, path)
    days = spark.createDataFrame([("1970-01-13", 1), ("1970-01-13", 2), ("1970-01-12", 0)], "day string, n int").withColumn(
        "day", F.col("day").cast("date")).where("n > 0")
    found = store.on_days(stored, days)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and {str(r.day) for r in found.collect()} == {"1970-01-13"}


def test_times_are_compared_with_literals(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = posts(spark).withColumn("created_time", F.col("created_time").cast(kind))
        for after, before in ((None, None), (10 * DAY + 5000, None), (None, 10 * DAY + 20_000), (10 * DAY + 4999, 10 * DAY + 15_001)):
            want = [r.id for r in df.orderBy("id").collect() if (after is None or r.created_utc > after) and (before is None or r.created_utc < before)]
            assert [r.id for r in filter_time_range(df, after, before).orderBy("id").collect()] == want
    plain = posts(spark).drop("created_time")
    assert filter_time_range(plain, 10 * DAY, 10 * DAY + 10_000).count() == 1


def plain_ranks(words, window=3):
    import numpy as np

    names = sorted(set(words))
    weight = np.zeros((len(names), len(names)))
    for i, a in enumerate(words):
        for b in words[i + 1:i + window]:
            if a != b:
                weight[names.index(a), names.index(b)] += 1
                weight[names.index(b), names.index(a)] += 1
    linked = weight.sum(axis=1) > 0
    share = weight / np.where(linked, weight.sum(axis=1), 1)[:, None]
    rank = np.linalg.solve(np.eye(len(names)) - 0.85 * share.T, np.full(len(names), 0.15))
    return {n: r for n, r, x in zip(names, rank, linked) if x}


def test_key_words_are_the_solution_of_the_ranks(spark):
    rng = random.Random(2)
    texts = {i: [f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randrange(60))] for i in range(12)}
    texts |= {20: [], 21: ["one"], 22: ["same"] * 9, 23: ["a", "b"], 24: None}
    df = spark.createDataFrame(list(texts.items()), "id long, words array<string>")
    got = {}
    for r in keywords.word_ranks(keywords.word_links(df)).collect():
        got.setdefault(r.id, {})[r.word] = r.rank
    for i, words in texts.items():
        want = plain_ranks(words or [])
        assert set(want) == set(got.get(i, {})) and all(abs(want[w] - got[i][w]) < 1e-6 for w in want)
    best = keywords.keywords(df, n=2).where("id = 23").orderBy("place").collect()
    assert [(r.word, r.rank) for r in best] == [("a", 1.0), ("b", 1.0)]
