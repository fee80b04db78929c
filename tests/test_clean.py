from forumlens.operators import clean
from tests.helpers import rows

SCHEMA = "id string, title string, url string, link_flair_text string, created_utc long"


def make(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_null_tags_survive_exclusion_and_are_filled(spark):
    posts = make(spark, ("a", "t", "u", "Retraction", 1), ("b", "t", "u", None, 1), ("c", "t", "u", "Health", 1))
    left = clean.exclude_tag(posts, "Retraction")
    assert sorted(r["id"] for r in left.collect()) == ["b", "c"]
    assert sorted(r["link_flair_text"] for r in clean.fill_missing_tag(left).collect()) == ["Health", "Tag Missing"]
    assert [r["id"] for r in clean.with_tags(posts, "Health", "Other").collect()] == ["c"]


def test_two_passes_in_order(spark):
    posts = make(spark, ("new", "T1", "U1", None, 30), ("mid", "T1", "U2", None, 20), ("old", "T2", "U2", None, 10))
    # title first drops mid, so old keeps its url; url first would drop old
    assert sorted(r["id"] for r in clean.dedupe_title_then_url(posts).collect()) == ["new", "old"]
    by_url = clean.keep_first(clean.keep_first(posts, "url", clean.newest_first()), "title", clean.newest_first())
    assert sorted(r["id"] for r in by_url.collect()) == ["new"]


def test_nulls_are_one_key_and_ties_go_by_id(spark):
    posts = make(spark, ("b", None, "U1", None, 5), ("a", None, "U2", None, 5), ("c", "T", None, None, 1),
                 ("d", "S", None, None, 2))
    kept = clean.dedupe_title_then_url(posts)
    assert sorted(r["id"] for r in kept.collect()) == ["a", "d"]
    assert kept.columns == posts.columns
    assert rows(clean.duplicate_counts(posts)) == [(1, 1)]


def test_a_crowd_of_copies_is_reduced_before_the_shuffle(spark):
    posts = spark.range(0, 20000, 1, 8).selectExpr(
        "cast(id as string) id", "if(id % 3 = 0, 'same', cast(id as string)) title", "cast(id as string) url",
        "cast(null as string) link_flair_text", "id created_utc")
    kept = clean.dedupe_title_then_url(posts)
    assert kept.count() == 20000 - 6667 + 1
    assert kept.where("title = 'same'").first()["id"] == "19998"
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") == 2 and "Window" not in plan


def test_repeated_keys(spark):
    posts = make(spark, ("a", "t", "u", None, 1), ("a", "t", "u", None, 1), ("b", "t", "u", None, 1))
    assert rows(clean.repeated_keys(posts)) == [("a", 2)]


def test_drop_columns_like(spark):
    posts = make(spark, ("a", "t", "u", None, 1))
    assert clean.drop_columns_like(posts, "flair").columns == ["id", "title", "url", "created_utc"]
