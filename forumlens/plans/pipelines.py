"""Corpora the recommender and the classifier start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.functions.text import normalized_words, terms
from forumlens.operators import bayes, clean, split, tfidf
from forumlens.operators.tuning import Choice
from forumlens.session import stage


def recommender_corpus(posts: DataFrame, excluded_tag: str) -> DataFrame:
    """Posts ready for comparison: tag excluded, missing tags filled, copies dropped, normalised."""
    kept = clean.dedupe_title_then_url(clean.fill_missing_tag(clean.exclude_tag(posts, excluded_tag)))
    words = kept.withColumn("words", normalized_words(F.col("title")))
    return words.withColumn("terms", terms(F.col("words"), lowercase=True))


def labelled_corpus(posts: DataFrame, label: str, classes: tuple) -> DataFrame:
    """Posts of the given classes without copies, normalised, upper and lower case kept apart."""
    of_classes = clean.with_tags(posts, *classes, column=label)
    words = clean.dedupe_title_then_url(of_classes).withColumn("words", normalized_words(F.col("title")))
    return words.select("id", "author", "title", "link_flair_text", F.col(label).alias("label"), "words",
                        terms(F.col("words"), lowercase=False).alias("terms"))


def tfidf_tables(corpus: DataFrame, rule: tfidf.VocabularyRule = tfidf.VocabularyRule()) -> tuple[DataFrame, DataFrame]:
    """Postings and staged vocabulary of a staged corpus."""
    postings = tfidf.term_counts(corpus)
    return postings, stage(tfidf.fit_vocabulary(postings, tfidf.corpus_size(corpus), rule))


def train_and_test(corpus: DataFrame, test_share: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Staged training and test rows (id, label, terms); the split is made on a staged corpus."""
    rows = stage(corpus.select("id", "label", "terms"))
    divided = split.stratified_split(tfidf.joined_terms(rows, "terms"), "label", test_share=test_share, seed=seed)
    divided = stage(tfidf.listed_terms(divided, "terms").select("id", "label", "terms", "split"))
    return (divided.where(F.col("split") == "train").drop("split"),
            divided.where(F.col("split") == "test").drop("split"))


def folded(train: DataFrame, n_folds: int = 3, seed: int = 0) -> DataFrame:
    divided = split.stratified_folds(tfidf.joined_terms(train, "terms"), "label", n_folds=n_folds, seed=seed)
    return stage(tfidf.listed_terms(divided, "terms").select(*train.columns, "fold"))


def evaluated(train: DataFrame, test: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """True and predicted label per test post (id, label, prediction)."""
    model = bayes.fit(train, choice.rule, choice.alpha)
    return test.select("id", "label").join(bayes.predict(test, model), "id")
