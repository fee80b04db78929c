"""Quality rules as a ledger: every rule is evaluated once, policies and ablations are bit operations on the stored bits.

``measure`` takes a document's measurements, ``ledger`` adds ``fail_bits``, one bit per rule of ``RULES``. A policy is a
named set of rules: a document is kept when it fails none of them. Changing a policy, or asking what a rule alone costs,
reads the ledger and never a text.

Words are the longest runs without ASCII white space. A null or empty text has no word and fails ``too_few_words``.
Rows are judged one by one: repeated rows and null ids get a row each, an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letter_words")

#: The place of a rule is its bit; new rules go to the end, so that stored ledgers stay readable.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "odd_word_length": "2 * word_chars < 5 * n_words OR word_chars > 15 * n_words",
    "shouting": "10 * n_upper > 3 * word_chars",
    "few_letter_words": "5 * n_letter_words < 3 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of what is kept: documents that fail none of ``rules``."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(RULES))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are sorted with their places; equal neighbours are repeats; each repeat covers up to the next one, three words
    at most. A text whose windows all differ is settled by their distinct count.
    """
    def covered(places: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(places)), F.lit(0),
            lambda total, k: total + F.coalesce(F.least(F.lit(3), F.get(places, k) - F.get(places, k - 1)), F.lit(3)))

    def repeats(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, k: (x["w"] == F.get(ordered, k - 1)["w"])
                        | (x["w"] == F.get(ordered, k + 1)["w"]).eqNullSafe(True))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def counted(windows: Column) -> Column:
        placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        found = _let(F.sort_array(placed), lambda ordered: _let(repeats(ordered), covered))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(found)

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(_let(windows, counted))

    return _let(words, of).cast("bigint")


def measurements(text: Column) -> dict[str, Column]:
    """The columns of ``MEASURES`` of a text; counts of characters are counts of code points."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, _SPACE_CHARS) != "")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(_without(text, _SPACE_CHARS)).cast("bigint"),
        "n_symbols": (F.char_length(text) - F.char_length(_without(text, _SYMBOLS))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": _repeat_words(words),
        "n_upper": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("bigint"),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("bigint"),
    }


def fail_bits() -> Column:
    """All rules' bits from the columns of ``MEASURES``."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, condition in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("bigint")


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, the measurements, fail_bits) of every row."""
    measured = docs.select(F.col(id_column).alias("doc_id"),
                           *(c.alias(name) for name, c in measurements(F.col(text_column)).items()))
    return measured.withColumn("fail_bits", fail_bits())


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(entries: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return entries.withColumn(column, ~fails(policy))


def ablations(entries: DataFrame, *policies: Policy) -> DataFrame:
    """(policy, without, n_docs, n_kept): documents kept by each policy, and by it without each of its rules.

    ``without`` is null for the whole policy. Rows are summed by their bits first; at most 2 ** rules sums are left.
    """
    sums = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    masks = [(p.name, rule, p.mask & ~(1 << list(RULES).index(rule)) if rule else p.mask)
             for p in policies for rule in (None, *p.rules)]
    choices = F.explode(F.array(*(F.struct(F.lit(name).alias("policy"), F.lit(rule).cast("string").alias("without"),
                                           F.lit(mask).cast("bigint").alias("mask")) for name, rule, mask in masks)))
    kept = F.when(F.col("fail_bits").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0)
    return (sums.select("fail_bits", "n", choices.alias("c")).select("fail_bits", "n", "c.*")
            .groupBy("policy", "without").agg(F.sum("n").alias("n_docs"), F.sum(kept).alias("n_kept")))


def filter_documents(docs: DataFrame, policy: Policy = STANDARD, text_column: str = "text") -> DataFrame:
    """The rows that the policy keeps, with their own columns, whatever these are called."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                      *(c.alias(name) for name, c in measurements(F.col(text_column)).items()))
    kept = row.withColumn("fail_bits", fail_bits()).where(~fails(policy))
    return kept.select("row.*")
