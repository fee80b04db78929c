import random

import pytest

from forumlens.operators import spread

SCHEMA = "id long, url string, channel string, at long"


def brute(posts):
    out = []
    whole = [p for p in posts if None not in p]
    for i, url, channel, at in whole:
        earlier = [(a, j, c) for j, u, c, a in whole if u == url and c != channel and (a, j) < (at, i)]
        if earlier:
            a, j, c = max(earlier)
            out.append((i, channel, at, j, c, a))
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 7, 50, 10_000])
def test_latest_earlier_post_of_another_channel(spark, bucket):
    rng = random.Random(bucket)
    posts = [(i, rng.choice(["u", "v", "w", "x"]), rng.choice("abc" if i % 5 else "a"), rng.randrange(300)) for i in range(500)]
    posts += [(1000 + i, "hot", "a" if i % 90 else "b", i // 3) for i in range(400)]  # long runs of one channel over many buckets
    posts += [(2000, None, "a", 1), (2001, "u", None, 1), (2002, "u", "a", None), (None, "u", "a", 1)]
    found = spread.hops(spark.createDataFrame(posts, SCHEMA), bucket)
    assert sorted(map(tuple, found.collect())) == brute(posts)


def test_between_channels(spark):
    posts = [(1, "u", "a", 0), (2, "u", "b", 10), (3, "u", "b", 15), (4, "u", "a", 18), (5, "v", "a", 3)]
    found = spread.between_channels(spread.hops(spark.createDataFrame(posts, SCHEMA)))
    assert sorted(map(tuple, found.collect())) == [("a", "b", 2, 25, 10, 15), ("b", "a", 1, 3, 3, 3)]
    assert spread.hops(spark.createDataFrame([], SCHEMA)).collect() == []
