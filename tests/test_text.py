from pyspark.sql import functions as F

from forumlens.functions import text
from forumlens.functions.words import LEMMAS, STOP_WORDS


def normalized(spark, title, **options):
    df = spark.createDataFrame([(1, title)], "id int, title string")
    return df.select(text.normalized_words(F.col("title"), **options)).first()[0]


def test_normalisation(spark):
    assert normalized(spark, "The Studies are showing 12 new mice in 2022") == ["study", "show", "new", "mouse"]
    assert normalized(spark, "US and us, Us") == ["US"]
    assert normalized(spark, "Einstein's brain isn't it's COVID-19 e.g. naïve élan") == [
        "Einstein", "brain", "COVID", "e", "g", "naïve", "élan"]
    assert normalized(spark, "brain brain") == ["brain", "brain"]
    assert normalized(spark, "the of and") == [] and normalized(spark, "") == []
    assert normalized(spark, None) is None


def test_own_words(spark):
    assert normalized(spark, "Der Hund und die Katzen", lemmas={"katzen": "katze"},
                      stop_words=("der", "die", "und")) == ["Hund", "katze"]
    assert normalized(spark, "The cat", lemmas={}, stop_words=()) == ["The", "cat"]


def test_dictionary_as_a_table_gives_the_same(spark):
    titles = ["The Studies are showing 12 new mice", "the of", "", "US made it better; Brains' and brain's", "What's up"]
    posts = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    table = spark.createDataFrame(list(LEMMAS.items()), "form string, lemma string")
    by_table = {r["id"]: r["words"] for r in text.normalize_by_table(posts, table).collect()}
    in_row = {r["id"]: r["w"] for r in posts.select("id", text.normalized_words(F.col("title")).alias("w")).collect()}
    assert by_table == in_row


def test_terms(spark):
    words = spark.createDataFrame([(["US", "a", "Brain"],)], "words array<string>")
    assert words.select(text.terms(F.col("words"), True)).first()[0] == ["us", "brain"]
    assert words.select(text.terms(F.col("words"), False)).first()[0] == ["US", "Brain"]


def test_a_large_dictionary_is_used_alike(spark):
    large = {f"form{i}x".replace("0", "a"): "base" for i in range(500)} | {"cells": "cell"}
    words = spark.createDataFrame([("Cells swim",)], "title string").select(text.normalized_words(F.col("title"), large))
    assert words.first()[0] == ["cell", "swim"]


def test_default_words():
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) < 200
    assert all(w.islower() for w in STOP_WORDS)
