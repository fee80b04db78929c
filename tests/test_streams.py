import uuid

import pytest
from pyspark.sql import functions as F

from forumlens.operators import bayes
from forumlens.sources import fixtures, tables
from forumlens.sources.schema import SEARCH_RESULT
from forumlens.sources.search import SearchSpec, live_view, matching_posts
from forumlens.streaming import activity, feed
from tests.helpers import rows


def post(i, title="brain", created=1651500000, score=1):
    return (f"p{i}", "ann", title, None, score, f"u{i}", 0, "science", created, None, "text", None)


@pytest.fixture
def inbox(spark, tmp_path):
    """A folder that is read as a stream, and a function that drops posts into it."""
    folder = str(tmp_path / "inbox")

    def deliver(*posts):
        spark.createDataFrame(list(posts), SEARCH_RESULT).withColumn(
            "created_time", F.timestamp_seconds("created_utc")).coalesce(1).write.mode("append").parquet(folder)

    deliver(post(1), post(2, "sea"), post(3, "Brains"))
    return folder, deliver, lambda: spark.readStream.schema(SEARCH_RESULT).parquet(folder)


def test_live_search_equals_batch(spark, inbox, tmp_path):
    folder, deliver, stream = inbox
    spec = SearchSpec(subreddit="science", keyword="brain")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    feed.write_feed(feed.live_search(stream(), spec), out, checkpoint).awaitTermination()
    deliver(post(4, "brain again"))
    feed.write_feed(feed.live_search(stream(), spec), out, checkpoint).awaitTermination()
    expected = live_view(matching_posts(spark.read.parquet(folder), spec))
    got = spark.read.schema(expected.schema).parquet(out)
    assert got.columns == expected.columns
    assert rows(got.drop("body")) == rows(expected.drop("body")) and got.count() == 3


def test_replayed_feed_adds_nothing(spark, inbox, tmp_path):
    _, deliver, stream = inbox
    tables.create_database(spark, "forum")
    table = f"forum.feed_{uuid.uuid4().hex}"
    tables.create_post_table(spark, table)
    feed.ingest_feed(stream(), table, str(tmp_path / "first")).awaitTermination()
    deliver(post(1, score=99), post(5))
    feed.ingest_feed(stream(), table, str(tmp_path / "first")).awaitTermination()
    feed.ingest_feed(stream(), table, str(tmp_path / "replay")).awaitTermination()
    got = spark.table(table).select("id", "score")
    assert rows(got) == [("p1", 1), ("p2", 1), ("p3", 1), ("p5", 1)]


def test_repeats_within_the_delay_are_dropped(spark, inbox, tmp_path):
    _, deliver, stream = inbox
    deliver(post(1), post(2, "sea"))
    out = str(tmp_path / "out")
    feed.write_feed(feed.first_seen(stream(), "1 hour"), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(spark.read.parquet(out).select("id")) == [("p1",), ("p2",), ("p3",)]


def test_scores_equal_batch(spark, inbox, tmp_path):
    folder, _, stream = inbox
    train = spark.createDataFrame([(1, "bio", ["brain"]), (2, "env", ["sea"]), (3, "bio", ["brain", "sea", "brain"])],
                                  "id long, label string, terms array<string>")
    model = bayes.fit(train)
    model.save(str(tmp_path / "model"))
    stored = bayes.NaiveBayesModel.load(spark, str(tmp_path / "model"))
    as_docs = lambda df: df.select("id", F.split(F.lower("title"), " ").alias("terms"))
    out = str(tmp_path / "out")
    feed.score_feed(as_docs(stream()), stored, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    assert rows(got) == rows(bayes.predict(as_docs(spark.read.parquet(folder)), model))


def windows(df):
    return sorted((r.window_start.hour, r.window_start.minute, r.tag, r.n_posts, r.n_comments, r.top_score) for r in df.collect())


def at(i, minute, tag="science", score=1):
    return (f"p{i}", "ann", "brain", None, score, f"u{i}", 2, tag, 1651500000 + 60 * minute, None, "text", None)  # 14:00


def test_closed_windows_late_posts_and_restart(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))

    def deliver(*posts):
        spark.createDataFrame(list(posts), SEARCH_RESULT).withColumn(
            "created_time", F.timestamp_seconds("created_utc")).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        counted = activity.activity(spark.readStream.schema(SEARCH_RESULT).parquet(inbox), "1 hour", "30 minutes", "subreddit")
        query = activity.write_closed(counted, out, checkpoint)
        query.awaitTermination()
        return query

    schema = activity.activity(spark.createDataFrame([], SEARCH_RESULT), tag="subreddit").schema
    deliver(at(1, 5), at(2, 50, score=7), at(3, 70), at(4, 55, "art"))
    assert activity.late_posts(run()) == 0
    assert windows(spark.read.schema(schema).parquet(out)) == []  # the watermark is at 14:40
    deliver(at(5, 59), at(6, 95))  # not too late; the watermark moves to 15:05
    assert activity.late_posts(run()) == 0
    closed = [(14, 0, "art", 1, 2, 1), (14, 0, "science", 3, 6, 7)]
    assert windows(spark.read.schema(schema).parquet(out)) == closed
    deliver(at(7, 10), at(8, 20, "art"), at(9, 96))
    assert activity.late_posts(run()) == 2
    assert windows(spark.read.schema(schema).parquet(out)) == closed
    deliver(at(10, 300))
    run()
    assert windows(spark.read.schema(schema).parquet(out)) == [*closed, (15, 0, "science", 3, 6, 1)]


def test_current_windows_hold_open_ones_and_late_posts(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    for posts in ([at(1, 5), at(2, 70), at(3, 71, "art")], [at(4, 200), at(5, 6)]):
        spark.createDataFrame(posts, SEARCH_RESULT).withColumn(
            "created_time", F.timestamp_seconds("created_utc")).coalesce(1).write.mode("append").parquet(inbox)
        counted = activity.activity(spark.readStream.schema(SEARCH_RESULT).parquet(inbox), tag="subreddit")
        activity.write_current(counted, out, checkpoint).awaitTermination()
    table = activity.current(spark, out)
    assert windows(table) == [(14, 0, "science", 2, 4, 1), (15, 0, "art", 1, 2, 1), (15, 0, "science", 1, 2, 1), (17, 0, "science", 1, 2, 1)]
    batch = activity.activity(spark.read.parquet(inbox), tag="subreddit")
    assert windows(batch) == windows(table)
    best = activity.most_active(table, F.timestamp_seconds(F.lit(1651500000 + 4000)))
    assert [r.tag for r in best.collect()] == ["art", "science"]


def test_documents_in_a_folder_of_files_arrive_too(spark, tmp_path):
    sf = str(tmp_path / "tables")
    numbers = spark.range(12)
    numbers.select(F.col("id").alias("doc_id"), F.lit("eau que").alias("text"), F.lit("fr").alias("lang"), F.lit("src0").alias("source"),
                   F.lit(7).cast("long").alias("n_chars")).repartition(3).write.parquet(f"{sf}/documents.parquet")
    numbers.select(F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
                   F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 3}').alias("props")).write.parquet(f"{sf}/events.parquet")
    numbers.limit(4).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{sf}/labels.parquet")
    out = str(tmp_path / "out")
    feed.write_feed(fixtures.posts_stream(spark, sf).select("id"), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in spark.read.schema("id long").parquet(out).collect()) == list(range(12))
