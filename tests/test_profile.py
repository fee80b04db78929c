import pytest

from forumlens.functions.text import word_count
from forumlens.operators import profile
from forumlens.sources.schema import THREAD
from tests.helpers import rows


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([
        (1, "ann", "A", 0, "one two"), (2, "ann", "B", 0, " three  words here "), (3, "ann", "A", 2, ""),
        (4, "bob", "A", 2, "x"), (5, None, "B", 2, "y"), (6, "cyd", None, 0, "z"), (7, "bob", "B", 1, "a b"),
    ], "id long, author string, link_flair_text string, num_comments long, title string")


def test_counts_skip_null_keys_but_shares_keep_the_whole(posts):
    assert rows(profile.count_by(posts, "link_flair_text")) == [("A", 3), ("B", 3)]
    shares = dict(rows(profile.share_by(posts)))
    assert shares["A"] == pytest.approx(300 / 7)


def test_pivot_and_back(posts):
    wide = profile.comments_by_tag_wide(posts, ("A", "B"))
    assert rows(wide) == [(0, 1, 1), (1, 0, 1), (2, 2, 1)]
    long = profile.comments_by_tag_long(wide, ("A", "B"))
    assert (1, "A", 0) in rows(long)
    assert sum(r[2] for r in rows(long)) == 6


def test_distinct_counts_null_once(posts):
    assert rows(profile.distinct_with_null(posts, "author", "n")) == [(4,)]
    assert [r[0] for r in profile.distinct_values(posts, "link_flair_text").collect()] == [None, "A", "B"]


def test_words(posts):
    counts = dict(posts.select("id", word_count(posts["title"])).collect())
    assert counts == {1: 2, 2: 3, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2}
    assert dict(rows(profile.avg_words_by(posts, word_count(posts["title"]))))["A"] == pytest.approx(1.0)
    assert rows(profile.avg_title_words(posts)) == [(pytest.approx(10 / 7),)]


def test_authors(posts):
    both = profile.authors_of_both_tags(posts, "A", "B")
    assert rows(both) == [("ann", 2, 1), ("bob", 1, 1)]
    assert [r["author"] for r in profile.most_active(both, 1).collect()] == ["ann"]
    assert rows(profile.avg_posts_per_author_tag(posts)) == [(pytest.approx(5 / 4),)]


def test_table_profile(posts):
    got = {r["column_name"]: tuple(r)[1:] for r in profile.table_profile(posts).collect()}
    assert got["author"] == ("string", 7, 6) and got["id"] == ("bigint", 7, 7)


def test_mode_breaks_ties_by_name(posts):
    assert profile.mode_of_tag(posts, posts["id"] > 0).first()["link_flair_text"] == "A"


def test_threads(spark):
    turns = spark.createDataFrame([(1, 0, "post"), (1, 2, "late"), (1, 1, "early"), (2, 0, "alone")],
                                  "conv_id long, turn long, text string")
    assert sorted(map(tuple, profile.thread_stats(turns).collect())) == [(1, 2, "early"), (2, 0, None)]
    nested = spark.createDataFrame([("a", [("hi",), ("ho",)]), ("b", []), ("c", None)], THREAD)
    got = {r["id"]: (r["n_comments"], r["first_comment"]) for r in profile.nested_thread_stats(nested).collect()}
    assert got == {"a": (2, "hi"), "b": (0, None), "c": (0, None)}
