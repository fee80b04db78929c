"""Ranked retrieval: the posts most relevant to each of a table of texts, by the cosine of TF-IDF vectors.

Exact, with upper bounds. The vocabulary knows the largest weight that a term has in any post. For a query, its term weight times this is
the most that the term adds to a score. First the rarest terms of each query are read, up to ``FIRST_POSTINGS`` postings or one term, and
the posts found there that add up to most are scored in full: the k-th of their scores is a threshold that k posts reach. Terms whose
largest contributions together stay below the threshold, the frequent ones first, need not be read: a post that has none of
the others cannot reach it. A post met in the others is scored in full only if what it has there and the largest
contributions of the terms left out together may reach the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.operators.similarity import DIGITS
from forumlens.session import stage

TOP = 10
#: Postings of its rarest terms that a query reads for its threshold, and posts scored in full for it, for each result wanted.
FIRST_POSTINGS = 200
TRIALS = 4
_SLACK = 1e-6


def bounded_vocabulary(unit_weights: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, df, idf, most): the vocabulary with the largest weight of each term, found inside the tasks first."""
    return vocabulary.join(unit_weights.groupBy("term").agg(F.max("w").alias("most")), "term").select("term", "df", "idf", "most")


def query_weights(texts: DataFrame, vocabulary: DataFrame, terms: str = "terms") -> DataFrame:
    """(query, term, q, df, most): the vector of length 1 of each text (id, terms) over the known terms."""
    counts = texts.select(F.col("id").alias("query"), F.explode(terms).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    raw = counts.join(vocabulary, "term").withColumn("x", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("query")))
    return raw.select("query", "term", (F.col("x") / length).alias("q"), "df", "most")


def _scored(pairs: DataFrame, queries: DataFrame, unit_weights: DataFrame) -> DataFrame:
    """(query, id, score) of written pairs (query, id), by all terms that both have."""
    wanted = pairs.join(queries.select("query", "term", "q"), "query")
    return wanted.join(unit_weights, ["id", "term"]).groupBy("query", "id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))


def _best(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def thresholds(queries: DataFrame, unit_weights: DataFrame, k: int) -> DataFrame:
    """(query, least): a score that k posts reach; no row where the rarest terms lead to fewer posts."""
    rare_first = Window.partitionBy("query").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rare_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = queries.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("df") <= FIRST_POSTINGS * k))
    partly = rare.join(unit_weights, "term").groupBy("query", "id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    tried = stage(_best(partly, TRIALS * k).select("query", "id"))
    found = _best(_scored(tried, queries, unit_weights), k)
    return found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query", "least")


def essential_terms(queries: DataFrame, least: DataFrame) -> DataFrame:
    """(query, term, q, rest, least) of the terms that must be read; ``rest`` is what the others add at most."""
    common_first = Window.partitionBy("query").orderBy(F.desc("df"), F.desc("term"))
    adds = F.col("q") * F.col("most")
    through = F.sum(adds).over(common_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = queries.withColumn("through", through).join(least, "query", "left").withColumn(
        "read", F.col("least").isNull() | (F.col("through") >= F.col("least") - _SLACK))
    rest = F.coalesce(F.max(F.when(~F.col("read"), F.col("through"))).over(Window.partitionBy("query")), F.lit(0.0))
    return marked.withColumn("rest", rest).where("read").select("query", "term", "q", "rest", F.coalesce("least", F.lit(0.0)).alias("least"))


def most_relevant(queries: DataFrame, unit_weights: DataFrame, k: int = TOP) -> DataFrame:
    """(query, id, sim, rank): the k posts most similar to each query among those that share a term with it, ties by id.

    ``queries`` as of ``query_weights`` and ``unit_weights`` (id, term, w) are staged or stored.
    """
    least = stage(thresholds(queries, unit_weights, k))
    read = stage(essential_terms(queries, least))
    met = read.join(unit_weights, "term").groupBy("query", "id").agg(
        F.sum(F.col("q") * F.col("w")).alias("part"), F.max("rest").alias("rest"), F.max("least").alias("least"))
    possible = stage(met.where(F.col("part") + F.col("rest") >= F.col("least") - _SLACK).select("query", "id"))
    scored = _scored(possible, queries, unit_weights).withColumn("score", F.round("score", DIGITS))
    return _best(scored, k).select("query", "id", F.col("score").alias("sim"), "rank")
