"""Post search: optional channel, keyword and time range, newest first, limited."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.sources.schema import LIVE_COLUMNS

# Result sizes when none is asked for, and the largest a web form may ask for.
DEFAULT_POSTS = 50
DEFAULT_POSTS_WEB = 5
MAX_POSTS_WEB = 20


def epoch_of(day: str) -> int:
    """Epoch seconds of UTC midnight of a ``yyyy-mm-dd`` date; raises ValueError if malformed."""
    return int(dt.datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc).timestamp())


@dataclass(frozen=True)
class SearchSpec:
    """What to search for; ``None`` means no restriction, for ``n_posts`` all. Times are epoch seconds, both exclusive."""

    subreddit: str | None = None
    keyword: str | None = None
    after: int | None = None
    before: int | None = None
    n_posts: int | None = DEFAULT_POSTS

    @classmethod
    def from_text(cls, subreddit: str = "", n_posts: str = "", start_date: str = "", end_date: str = "",
                  keyword: str = "", web: bool = False, today: dt.date | None = None) -> SearchSpec:
        """Normalise typed-in fields: a blank field is no restriction, a bad one raises ValueError."""
        if n_posts:
            wanted = int(n_posts)
        else:
            wanted = DEFAULT_POSTS_WEB if web else DEFAULT_POSTS
        if web and not 0 <= wanted <= MAX_POSTS_WEB:
            raise ValueError(f"number of posts must lie between 0 and {MAX_POSTS_WEB}")
        if web and wanted == 0:
            wanted = DEFAULT_POSTS_WEB  # a form treats 0 as not filled in
        if not web and wanted <= 0:
            raise ValueError("number of posts must be positive")
        after = epoch_of(start_date) if start_date else None
        before = epoch_of(end_date) if end_date else None
        if web and after is not None:
            latest = epoch_of((today or dt.datetime.now(dt.timezone.utc).date()).isoformat())
            if after > latest:
                raise ValueError("start date must not be later than today")
        if web and after is not None and before is not None and before < after:
            raise ValueError("end date must not be earlier than start date")
        return cls(subreddit or None, keyword or None, after, before, wanted)


def mentions(keyword: str, *columns: str) -> Column:
    """Case-insensitive containment of one keyword, taken literally, in any of the text columns."""
    return F.lower(F.concat_ws(" ", *columns)).contains(keyword.lower())


def filter_keyword(posts: DataFrame, keyword: str | None) -> DataFrame:
    if keyword is None:
        return posts
    texts = [c for c in ("title", "selftext") if c in posts.columns]
    return posts.where(mentions(keyword, *texts))


def _time(seconds: int, kind: str) -> Column:
    text = dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(text).cast(kind) if kind == "timestamp_ntz" else F.timestamp_seconds(F.lit(seconds))


def filter_time_range(posts: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Posts created after and before the given seconds since 1970, both bounds exclusive in whole seconds.

    Where the table has the time itself, it is compared with literal times, which reach the scan.
    """
    kind = dict(posts.dtypes).get("created_time")
    if kind not in ("timestamp", "timestamp_ntz"):
        lower, upper, time = after, before, F.col("created_utc")
        return posts.where(F.lit(True) if lower is None else time > lower).where(F.lit(True) if upper is None else time < upper)
    if after is not None:
        posts = posts.where(F.col("created_time") >= _time(after + 1, kind))
    if before is not None:
        posts = posts.where(F.col("created_time") < _time(before, kind))
    return posts


def filter_channel(posts: DataFrame, subreddit: str | None) -> DataFrame:
    return posts if subreddit is None else posts.where(F.col("subreddit") == subreddit)


def matching_posts(posts: DataFrame, spec: SearchSpec) -> DataFrame:
    """Every post the specification admits; stateless, so it also runs on a stream."""
    channel = filter_channel(posts, spec.subreddit)
    return filter_keyword(filter_time_range(channel, spec.after, spec.before), spec.keyword)


def search_posts(posts: DataFrame, spec: SearchSpec) -> DataFrame:
    """The newest ``n_posts`` matches, or all in no order: the limit runs inside each task before results meet."""
    found = matching_posts(posts, spec)
    return found if spec.n_posts is None else found.orderBy(F.desc("created_utc"), "id").limit(spec.n_posts)


def typed_result(raw: DataFrame) -> DataFrame:
    """Cast the counters of raw search rows and add the readable UTC time."""
    counters = {c: F.col(c).cast("bigint") for c in ("score", "num_comments", "created_utc")}
    return raw.withColumns(counters).withColumn("created_time", F.timestamp_seconds("created_utc"))


def live_view(posts: DataFrame) -> DataFrame:
    """The eight columns of the live feed: the body is the post's own text, the time its creation."""
    body = F.col("selftext") if "selftext" in posts.columns else F.lit(None).cast("string")
    return posts.withColumn("body", body).select(*LIVE_COLUMNS)
