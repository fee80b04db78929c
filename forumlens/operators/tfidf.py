"""TF-IDF as relations: postings (id, term, tf), vocabulary (term, df, cf, idf), weights (id, term, w).

Nothing is held on the driver and no group is wider than one post, so the vocabulary may grow
with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of posts that one task holds together as arrays.
BLOCK_WORDS = 1 << 22


@dataclass(frozen=True)
class VocabularyRule:
    """Which terms are kept. Document frequency limits are counts, or shares when float."""

    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None


def as_count(limit: int | float, n_docs: Column) -> Column:
    return n_docs * F.lit(limit) if isinstance(limit, float) else F.lit(limit)


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def term_counts(docs: DataFrame, terms: str = "terms", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Postings: how often each term occurs in each post.

    The posts are spread by id while their terms are still one array per post. Counting, and
    later sums per post, then need no further exchange of the many postings; vocabulary and
    weights read the same exchange.
    """
    return (
        _spread(docs.select(*keep, F.col(terms).alias("_terms")), "id").select(*keep, F.explode("_terms").alias("term"))
        .groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def joined_terms(posts: DataFrame, terms: str) -> DataFrame:
    """Posts whose array of terms is one string, which takes half the room in a shuffle, unless a line end or a null is in it; see ``listed_terms``."""
    plain = F.coalesce((F.size(terms) > 0) & ~F.exists(terms, lambda t: t.isNull() | t.contains("\n")), F.lit(False))
    return posts.withColumns({"_joined": F.when(plain, F.array_join(terms, "\n")), "_listed": F.when(~plain, F.col(terms))}).drop(terms)


def listed_terms(posts: DataFrame, terms: str) -> DataFrame:
    return posts.withColumn(terms, F.coalesce(F.split("_joined", "\n"), "_listed")).drop("_joined", "_listed")


def _spread(posts: DataFrame, by: str) -> DataFrame:
    """Posts with their array ``_terms``, dealt by a column."""
    return listed_terms(joined_terms(posts, "_terms").repartition(by), "_terms")


def fit_vocabulary(postings: DataFrame, n_docs: Column, rule: VocabularyRule = VocabularyRule()) -> DataFrame:
    """Document and corpus frequency of each kept term, and its idf.

    Frequencies are summed inside tasks before the shuffle, so a term in every post costs one
    row per task. ``max_features`` keeps the terms most frequent in the corpus.
    """
    vocabulary = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if isinstance(rule.min_df, float) or rule.min_df > 1:
        vocabulary = vocabulary.where(F.col("df") >= as_count(rule.min_df, n_docs))
    if isinstance(rule.max_df, int) or rule.max_df < 1:
        vocabulary = vocabulary.where(F.col("df") <= as_count(rule.max_df, n_docs))
    if rule.max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("cf"), "term").limit(rule.max_features)
    return vocabulary.withColumn("idf", smooth_idf(n_docs, F.col("df")))


def raw_weights(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unnormalised weights ``x`` of known terms.

    Pass a stored or staged vocabulary. The planner then knows its size and broadcasts a small
    one; a large one is merged, and adaptive execution splits the partitions of hot terms, which
    it can do only where the other side of the join is a plain scan.
    """
    return postings.join(vocabulary.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf"))


def dealt(docs: DataFrame, keep: tuple[str, ...] = ("id",), terms: str = "terms") -> DataFrame:
    """(block, keep..., _terms): stored or staged posts dealt by id into blocks of about ``BLOCK_WORDS`` words."""
    counted = F.coalesce(F.when(F.col(terms).isNotNull(), F.size(terms)), F.lit(0)).cast("bigint")
    n_blocks = max(1, -(-(docs.agg(F.sum(counted)).first()[0] or 0) // BLOCK_WORDS))
    return _spread(docs.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), *keep, F.col(terms).alias("_terms")), "block")


def in_blocks(docs: DataFrame, known: DataFrame, make: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str,
              keep: tuple[str, ...] = ("id",), terms: str = "terms", gaps: bool = False) -> DataFrame:
    """What ``make`` makes of each block of posts: no posting is a row of a shuffle.

    ``docs`` and ``known`` (term, numbers...), one row a term, are stored or staged tables. Posts are dealt into blocks of about ``BLOCK_WORDS`` words by id, so posts with
    one id are in one block, and a block gets the row of each of its terms once. ``make`` gets the posts (``keep``), the rows of
    their terms, and for every word whose term is known the place of its post and of its term; with ``gaps`` the other words too, at place -1. It is a
    function inside another one, so that executors need not have this package.
    """
    posts = dealt(docs, keep, terms)
    # a term is looked for once in each block; counting inside the blocks needs no exchange
    wanted = posts.select(F.expr("block + 0").alias("of_block"), "block", F.explode("_terms").alias("term")).groupBy("block", "of_block", "term").count()
    wanted = wanted.select("of_block", "term").join(known, "term")

    def of_block(posts: pa.Table, known: pa.Table) -> pa.Table:
        lists = posts["_terms"].combine_chunks()
        place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known["term"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        post = np.repeat(np.arange(len(posts)), sizes)
        return make(posts, known, post, place) if gaps else make(posts, known, post[place >= 0], place[place >= 0])

    return posts.groupBy("block").cogroup(wanted.groupBy("of_block")).applyInArrow(of_block, schema)


def weights(postings: DataFrame, vocabulary: DataFrame, by: tuple[str, ...] = ("id",), docs: DataFrame | None = None) -> DataFrame:
    """Weights scaled to unit length per post.

    With ``docs``, the stored or staged posts (id, terms) that the postings come from, they are made in blocks of posts: only the texts and
    a block's rows of the vocabulary move, instead of every posting twice. The vocabulary then is staged too.
    """
    if docs is None:
        raw = raw_weights(postings, vocabulary)
        length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by)))
        return raw.withColumn("w", F.col("x") / length).drop("x", "idf", "tf")

    def weigh(posts: pa.Table, known: pa.Table, post: np.ndarray, place: np.ndarray) -> pa.Table:
        ids = posts["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        n = max(len(known), 1)
        entry, tf = np.unique(ids.indices.to_numpy()[post].astype(np.int64) * n + place, return_counts=True)
        own, term = entry // n, entry % n
        x = tf * known["idf"].to_numpy()[term]
        length = np.sqrt(np.bincount(own, weights=x * x, minlength=len(ids.dictionary)))
        return pa.table({"term": known["term"].combine_chunks().take(pa.array(term)), "id": ids.dictionary.take(pa.array(own)), "w": x / length[own]})

    kinds = docs.schema["id"].dataType.simpleString()
    return in_blocks(docs, vocabulary.select("term", "idf"), weigh, f"term string, id {kinds}, w double")


def corpus_size(docs: DataFrame) -> Column:
    """Number of posts, as a scalar subquery; posts without a term count too."""
    return docs.agg(F.count(F.lit(1)).alias("n")).scalar()
