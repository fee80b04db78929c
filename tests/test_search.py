import datetime as dt

import pytest
from pyspark.sql import functions as F

from forumlens.sources.search import (SearchSpec, epoch_of, filter_keyword, filter_time_range, live_view,
                                      search_posts, typed_result)


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([
        ("a", "Brain scans", "", 3, "u1", 1, "science", 100),
        ("b", "Nothing here", "about the BRAIN", 2, "u2", 0, "science", 200),
        ("c", "100% sure_thing", None, 1, "u3", 5, "science", 300),
        ("d", "1000 sureXthing", None, 1, "u4", 5, "other", 300),
    ], "id string, title string, selftext string, score long, url string, num_comments long, subreddit string, "
       "created_utc long")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_keyword_is_literal_and_ignores_case(posts):
    assert sorted(ids(filter_keyword(posts, "brain"))) == ["a", "b"]
    assert ids(filter_keyword(posts, "100%")) == ["c"]
    assert ids(filter_keyword(posts, "sure_")) == ["c"]
    assert len(ids(filter_keyword(posts, None))) == 4


def test_time_bounds_are_exclusive_and_optional(posts):
    assert sorted(ids(filter_time_range(posts, 100, 300))) == ["b"]
    assert sorted(ids(filter_time_range(posts, after=200))) == ["c", "d"]
    assert sorted(ids(filter_time_range(posts, before=200))) == ["a"]


def test_newest_first_with_ties_by_id_and_limit(posts):
    assert ids(search_posts(posts, SearchSpec(n_posts=3))) == ["c", "d", "b"]
    assert ids(search_posts(posts, SearchSpec(subreddit="science", keyword="brain"))) == ["b", "a"]


def test_live_view_renames_and_drops(posts):
    view = live_view(posts.withColumn("created_time", F.timestamp_seconds("created_utc")))
    assert view.columns == ["title", "score", "id", "subreddit", "url", "num_comments", "body", "created_time"]


def test_typed_result(spark):
    raw = spark.createDataFrame([("a", "1", "2", "1651500000")], "id string, score string, num_comments string, created_utc string")
    row = typed_result(raw).first()
    assert (row["score"], row["num_comments"], row["created_utc"]) == (1, 2, 1651500000)
    assert row["created_time"] == dt.datetime(2022, 5, 2, 14, 0)


def test_spec_from_text():
    assert SearchSpec.from_text() == SearchSpec(n_posts=50)
    assert SearchSpec.from_text(web=True).n_posts == 5
    assert SearchSpec.from_text(web=True, n_posts="0").n_posts == 5
    spec = SearchSpec.from_text("science", "7", "2022-05-01", "2022-05-02", "brain")
    assert spec == SearchSpec("science", "brain", epoch_of("2022-05-01"), epoch_of("2022-05-02"), 7)
    assert epoch_of("1970-01-02") == 86400


@pytest.mark.parametrize("fields", [
    {"n_posts": "0"}, {"n_posts": "-3"}, {"n_posts": "x"}, {"start_date": "2022-13-01"}, {"start_date": "May 1"},
    {"n_posts": "21", "web": True}, {"start_date": "2023-01-01", "web": True, "today": dt.date(2022, 1, 1)},
    {"start_date": "2022-05-02", "end_date": "2022-05-01", "web": True},
])
def test_bad_fields_are_rejected(fields):
    with pytest.raises(ValueError):
        SearchSpec.from_text(**fields)


def test_end_without_start_is_allowed():
    assert SearchSpec.from_text(end_date="2022-05-01", web=True).after is None


def test_filters_reach_the_scan(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = documents.where(F.col("source") == "src0").select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(source,src0)" in plan
    assert "text" not in plan.split("ReadSchema:")[1]
