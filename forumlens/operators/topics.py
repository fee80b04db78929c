"""Topics of a corpus: LDA, the leading words of each topic, and the tag that names it."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.operators.profile import mode_of_tag

# Topics, their leading words and passes over the corpus.
N_TOPICS = 2
N_TOP_WORDS = 5
PASSES = 10


def fit_topics(vectors: DataFrame, n_topics: int = N_TOPICS, seed: int = 0) -> LDAModel:
    """Online variational LDA over the full corpus in every pass."""
    return LDA(k=n_topics, optimizer="online", subsamplingRate=1.0, maxIter=PASSES, seed=seed,
               featuresCol="features").fit(vectors)


def topic_of_posts(model: LDAModel, vectors: DataFrame) -> DataFrame:
    """Topic shares per post (id, topics)."""
    return model.transform(vectors).select("id", vector_to_array("topicDistribution").alias("topics"))


def top_words(model: LDAModel, names: list[str], n: int = N_TOP_WORDS) -> DataFrame:
    """Leading words per topic (topic, rank, term, weight); names are the vocabulary in order."""
    spark = model.describeTopics(1).sparkSession
    vocabulary = spark.createDataFrame(list(enumerate(names)), "index int, term string")
    described = model.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "e"))
    return described.join(vocabulary, F.col("e.termIndices") == F.col("index")).select(
        "topic", (F.col("pos") + 1).alias("rank"), "term", F.col("e.termWeights").alias("weight"))


def mentions_term(words: Column, term: str) -> Column:
    """The normalised text contains the term, also inside a longer word."""
    return F.concat_ws(" ", words).contains(term)


def tag_for_term(docs: DataFrame, term: str, tag_column: str = "link_flair_text") -> DataFrame:
    """The most frequent tag among posts that mention the term."""
    return mode_of_tag(docs, mentions_term(F.col("words"), term), tag_column)


def name_topics(words: DataFrame, docs: DataFrame, tag_column: str = "link_flair_text") -> DataFrame:
    """(topic, term, tag): for each topic the most frequent tag among posts that mention its first word.

    All topics are counted in one pass over the posts; the first words, one per topic, come to the driver. Ties go to
    the smaller tag; the tag is NULL where no tagged post mentions the word.
    """
    firsts = words.where(F.col("rank") == 1).select("topic", "term").collect()
    text = F.concat_ws(" ", "words")
    named = [F.when(text.contains(r["term"]), F.lit(r["topic"])) for r in firsts]
    tagged = docs.where(F.col(tag_column).isNotNull()).select(
        F.col(tag_column).alias("tag"), F.explode(F.array_compact(F.array(*named))).alias("topic"))
    counts = tagged.groupBy("topic", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("topic").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))
    every = docs.sparkSession.createDataFrame([(r["topic"], r["term"]) for r in firsts], "topic int, term string")
    return every.join(best, "topic", "left")
