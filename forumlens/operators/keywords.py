"""Key words of texts: words that many other words stand beside, by weighted PageRank on each text's own graph of words.

Two words are linked as often as they stand within ``WINDOW`` words of each other. A word's rank is 1 - ``DAMPING`` plus
``DAMPING`` times the ranks of its neighbours, each shared out by the weights of its links. All texts are ranked together: a round is one
join of links with ranks and one aggregation, by text and word, so neither a long text nor many texts meet in one task. Rounds go on until no
rank moves by more than ``TOLERANCE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import stage

WINDOW = 3
DAMPING = 0.85
TOLERANCE = 1e-8
WORDS = 5
#: Rounds between two looks at how far ranks still move.
ROUNDS_AT_ONCE = 8


def word_links(texts: DataFrame, words: str = "words", window: int = WINDOW) -> DataFrame:
    """(id, a, b, weight) of texts (id, words): how often two different words stand within the window, both ways."""
    pairs = F.flatten(F.transform(words, lambda w, i: F.transform(
        F.slice(words, i + 2, F.lit(window - 1)), lambda b: F.struct(w.alias("a"), b.alias("b")))))
    each = texts.select("id", F.explode(pairs).alias("p")).select("id", "p.a", "p.b").where(F.col("a") != F.col("b"))
    return each.union(each.select("id", "b", "a")).groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("weight"))


def word_ranks(links: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, word, rank) of every word that has a link; ``links`` as of ``word_links``."""
    strength = Window.partitionBy("id", "a")
    shares = stage(links.select("id", "a", "b", (F.col("weight") / F.sum("weight").over(strength)).alias("share")))
    ranks = stage(shares.select("id", F.col("a").alias("word")).distinct().withColumn("rank", F.lit(1.0)))
    while True:
        now = ranks
        for _ in range(ROUNDS_AT_ONCE):
            before = now
            given = shares.join(now.withColumnRenamed("word", "a"), ["id", "a"])
            now = given.groupBy("id", F.col("b").alias("word")).agg(
                (F.lit(1 - DAMPING) + F.lit(DAMPING) * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        moved = now.join(before.withColumnRenamed("rank", "previous"), ["id", "word"])
        moved = stage(moved.withColumn("step", F.abs(F.col("rank") - F.col("previous"))))
        ranks = moved.select("id", "word", "rank")
        if not (moved.agg(F.max("step")).first()[0] or 0) > tolerance:
            return ranks


def keywords(texts: DataFrame, words: str = "words", n: int = WORDS) -> DataFrame:
    """(id, place, word, rank) of the n words that rank highest in each text, ranks rounded to six digits, ties by word.

    A text whose words have no neighbours has none.
    """
    rounded = word_ranks(word_links(texts, words)).withColumn("rank", F.round("rank", 6))
    order = Window.partitionBy("id").orderBy(F.desc("rank"), "word")
    return rounded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("id", "place", "word", "rank")
