import datetime as dt
import os

import pytest

from forumlens.operators import ingest
from forumlens.session import stage
from forumlens.sources import files, tables
from forumlens.sources.schema import SEARCH_RESULT, STORED_POST
from tests.helpers import rows

TIME = dt.datetime(2022, 5, 2, 14, 0)
POST = ("a1", "ann", 'A "quoted", title', "two\nlines", 3, "http://x/?a=1&amp;b=2", 4, "science", 1651500000,
        "Health", "richtext", TIME)
LINK = ("a2", "bob", "Plain", None, 1, "http://y", 0, "science", 1651500000, None, "text", TIME)


@pytest.fixture
def posts(spark):
    return spark.createDataFrame([POST, LINK], SEARCH_RESULT)


def test_result_file_round_trip(spark, posts, tmp_path):
    path = files.write_result(posts, str(tmp_path / "new_folder"), dt.datetime(2022, 5, 2, 23, 1, 25))
    assert os.path.basename(path) == "search_2022_05_02-23_01_25.csv"
    assert rows(files.read_results(spark, [path]).orderBy("id").fillna("")) == rows(posts.fillna(""))


def test_headers_in_different_orders_and_missing_columns(spark, tmp_path):
    first, second = str(tmp_path / "1.csv"), str(tmp_path / "2.csv")
    with open(first, "w") as f:
        f.write('author,id,title,score\nann,a1,"two\nlines and ""quotes""",5\n')
    with open(second, "w") as f:
        f.write("id,author,title,score,link_flair_text\na2,bob,t,6,\n")
    read = files.read_results(spark, [first, second])
    assert read.schema == SEARCH_RESULT
    got = {r["id"]: r for r in read.collect()}
    assert got["a1"]["author"] == "ann" and got["a1"]["title"] == 'two\nlines and "quotes"'
    assert got["a2"]["author"] == "bob" and got["a2"]["link_flair_text"] is None and got["a1"]["url"] is None


def test_raw_posts_may_lack_attributes(spark, tmp_path):
    path = str(tmp_path / "raw.json")
    with open(path, "w") as f:
        f.write('{"id": "a1", "title": "t", "created_utc": 1651500000, "score": 2, "extra": 1}\n')
        f.write('{"id": "a2", "title": "s", "created_utc": 1651500000, "link_flair_text": "Health"}\n')
    read = files.read_raw_posts(spark, path)
    assert read.schema == SEARCH_RESULT
    got = {r["id"]: r for r in read.collect()}
    assert got["a1"]["link_flair_text"] is None and got["a2"]["link_flair_text"] == "Health"
    assert got["a1"]["created_time"] == TIME and got["a2"]["score"] is None


def test_staging_round_trip_replaces_and_stamps(spark, posts, tmp_path):
    path = str(tmp_path / "staging")
    files.write_staging(posts, path)
    files.write_staging(posts.where("id = 'a1'"), path)
    loaded = files.read_staging(spark, path)
    assert loaded.columns == STORED_POST.names
    row = loaded.first()
    assert loaded.count() == 1 and row["selftext"] == "two\nlines" and row["created_time"] == TIME
    assert row["updated_time"] is not None


def test_catalog(spark, posts):
    tables.create_database(spark, "forum")
    tables.create_database(spark, "forum")
    tables.require_database(spark, "forum")
    with pytest.raises(LookupError):
        tables.require_database(spark, "nowhere")
    with pytest.raises(LookupError):
        tables.require_table(spark, "forum.nothing")
    tables.create_post_table(spark, "forum.typed")
    tables.create_post_table(spark, "forum.typed")
    assert tables.column_types(spark, "forum.typed")[0] == ("id", "string")
    assert [n for n, _ in tables.column_types(spark, "forum.typed")] == STORED_POST.names
    tables.replace_staging(posts, "forum.staged")
    tables.replace_staging(posts.where("id = 'a2'"), "forum.staged")
    assert [r["id"] for r in spark.table("forum.staged").collect()] == ["a2"]


def test_insert_keeps_the_first_seen_row(spark, posts):
    tables.create_database(spark, "forum")
    tables.create_post_table(spark, "forum.kept", buckets=4)
    ingest.insert_if_absent(posts.where("id = 'a1'"), "forum.kept")
    ingest.insert_if_absent(posts.selectExpr("* except (score)", "score + 100 as score").select(*posts.columns),
                            "forum.kept")
    ingest.insert_if_absent(posts, "forum.kept")
    stored = spark.table("forum.kept")
    assert sorted((r["id"], r["score"]) for r in stored.collect()) == [("a1", 3), ("a2", 101)]
    assert stored.where("updated_time is null").count() == 0


def test_repeats_within_a_batch(spark, posts):
    tables.create_database(spark, "forum")
    tables.create_post_table(spark, "forum.strict")
    twice = posts.unionAll(posts)
    with pytest.raises(ingest.DuplicateKeys):
        ingest.insert_if_absent(twice, "forum.strict")
    ingest.insert_if_absent(twice, "forum.strict", tolerate_duplicates=True)
    assert spark.table("forum.strict").count() == 2


def test_a_small_batch_does_not_shuffle_the_stored_table(spark):
    stored = spark.range(1_000_000).selectExpr("cast(id as string) id", "'old' origin")
    batch = stage(spark.createDataFrame([("5", "new"), ("x", "new")], "id string, origin string"))
    added = ingest.absent_rows(stored, batch)
    assert [tuple(r) for r in added.collect()] == [("x", "new")]
    final = added._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    stored_side = final[final.index("LeftSemi"):]
    assert "BroadcastHashJoin" in final[:final.index("LeftSemi")][-60:]
    assert "hashpartitioning" not in stored_side and "Range (0, 1000000" in stored_side


def test_latest_version_replaces_the_whole_document(spark):
    versions = spark.createDataFrame([
        ("ada", 1, "Ada", "Byron", 1815), ("ada", 2, "Ada", None, 1815), ("al", 1, "Alan", "Turing", 1912),
    ], "doc string, version int, first string, last string, born int")
    latest = ingest.latest_by_key(versions, "doc", [versions["version"]])
    assert sorted((r["doc"], r["last"]) for r in latest.collect()) == [("ada", None), ("al", "Turing")]
