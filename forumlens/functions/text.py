"""Text expressions, all built in: words, tokens, normalised words and vectoriser terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions.words import LEMMAS, STOP_WORDS

# A token is a run of word characters, with inner apostrophes; a vectoriser term
# has at least two of them.
TOKEN = r"[\p{L}\p{N}_]+(?:['’]\p{L}+)*"
ALPHABETIC = r"^\p{L}+$"
MIN_TERM_LENGTH = 2

# A literal map is searched from its start, so larger dictionaries go through a join.


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    words = F.split(text, r"(?U)\s+")
    return F.size(F.filter(words, lambda w: w != "")).cast("bigint")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _stem(token: Column) -> Column:
    """The token without a possessive ending."""
    possessive = F.endswith(token, F.lit("'s")) | F.endswith(token, F.lit("’s"))
    return F.when(possessive, F.substring(token, F.lit(1), F.length(token) - 2)).otherwise(token)


def _is_acronym(token: Column) -> Column:
    """Written in capitals throughout, such as US, which differs from us."""
    return (F.length(token) > 1) & (token == F.upper(token)) & (token != F.lower(token))


def _in_words(word: Column, words) -> Column:
    return word.isin(*words) if words else F.lit(False)


def normalized_words(text: Column, lemmas: dict[str, str] | None = None,
                     stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lemmas of the alphabetic, non-stop words of a text, in order; repeats are kept.

    Forms and stop words are matched in lower case, acronyms are left as they are. Stays within
    the row, so normalising a corpus needs no shuffle. What becomes of each listed form is
    settled here, so most words cost two set lookups.
    """
    lemmas = LEMMAS if lemmas is None else lemmas
    outcome = {form: lemmas.get(form, form) for form in [*lemmas, *(w.lower() for w in stop_words)]}
    dropped = [form for form, lemma in outcome.items() if lemma in stop_words or not lemma.isalpha()]
    replaced = {form: lemma for form, lemma in outcome.items() if form not in dropped}

    def kept(t: Column) -> Column:
        return t.rlike(ALPHABETIC) & ~(_in_words(F.lower(t), dropped) & ~_is_acronym(t)) & ~_in_words(t, capitals)

    def lemma_of(t: Column) -> Column:
        if not replaced:
            return t
        table = F.create_map(*[F.lit(x) for pair in replaced.items() for x in pair])
        listed = _in_words(F.lower(t), list(replaced)) & ~_is_acronym(t)
        return F.when(listed, F.element_at(table, F.lower(t))).otherwise(t)

    capitals = [w for w in stop_words if w != w.lower()]
    return F.transform(F.filter(F.transform(tokens(text), _stem), kept), lemma_of)


def _is_kept(lemma: Column, stop_words: tuple[str, ...]) -> Column:
    return lemma.rlike(ALPHABETIC) & ~_in_words(lemma, stop_words)


def normalize_by_table(posts: DataFrame, lemma_table: DataFrame, id_column: str = "id", text_column: str = "title",
                       stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``normalized_words`` with a dictionary of any size, given as rows ``(form, lemma)``.

    The join side is left to the optimiser, which broadcasts the dictionary only when its size
    allows. A post without any kept word has an empty list.
    """
    exploded = posts.select(id_column, F.posexplode(F.transform(tokens(F.col(text_column)), _stem)).alias("pos", "t"))
    dictionary = lemma_table.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
    joined = exploded.join(dictionary, F.lower("t") == F.col("_form"), "left")
    lowered = F.lower("t")
    lemma = F.when(_is_acronym(F.col("t")), F.col("t")).otherwise(
        F.coalesce("_lemma", F.when(_in_words(lowered, stop_words), lowered), F.col("t")))
    kept = joined.select(id_column, "pos", lemma.alias("w")).where(_is_kept(F.col("w"), stop_words))
    words = kept.groupBy(id_column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("words"))
    return posts.join(words, id_column, "left").withColumn(
        "words", F.coalesce("words", F.array().cast("array<string>")))


def terms(words: Column, lowercase: bool) -> Column:
    """What the vectoriser counts: words of two or more characters, optionally lower-cased."""
    long_enough = F.filter(words, lambda w: F.length(w) >= MIN_TERM_LENGTH)
    return F.transform(long_enough, F.lower) if lowercase else long_enough
