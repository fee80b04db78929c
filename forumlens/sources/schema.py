"""Schemas of posts and of the shapes derived from them."""

from pyspark.sql import types as T

# The attributes of a post, in the order of a search result.
POST_ATTRIBUTES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("link_flair_type", T.StringType()),
])

# A search result adds the readable time, a stored post also the time of its ingest.
SEARCH_RESULT = T.StructType(POST_ATTRIBUTES.fields + [T.StructField("created_time", T.TimestampType())])
STORED_POST = T.StructType(SEARCH_RESULT.fields + [T.StructField("updated_time", T.TimestampType())])

# The narrower projections shown to a reader or taken from the live feed.
SEARCH_DISPLAY = ("author", "id", "title", "url", "subreddit", "link_flair_text", "created_time")
LIVE_COLUMNS = ("title", "score", "id", "subreddit", "url", "num_comments", "body", "created_time")

# A post with its comments nested, as one thread arrives from the feed.
THREAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("comments", T.ArrayType(T.StructType([T.StructField("body", T.StringType())]))),
])
