"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are lower-cased in A-Z and cut into words (runs of digits, letters and everything beyond ASCII). The automaton of all
items' words is walked with a document's words; the state and the length of the longest match that ends at a word are
known at each step. A window is ``window`` consecutive words of one item, a shorter item is one window as a whole; words
inside an occurrence of a window are hit. Runs of words that no item has, or that are shorter than the shortest window,
cannot hold an occurrence and are skipped.

Null and empty texts have no words and no hits; an empty benchmark hits nothing; an item without words or with a null id
counts in no list of items, though a null item's windows hit. Repeated documents get a row each, repeated items count once.

Items are broadcast in shards of at most ``SHARD_CHARS`` characters, counted first; documents pass every shard.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import map_batches, record_batch, text_key
from forumlens.session import stage

WINDOW = 13
#: An automaton takes about 100 bytes a character in every worker.
SHARD_CHARS = 1 << 20

_WORD_BYTE = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
_NORMAL = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTE else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of the word sequences of items, with the items of every window.

    States are numbers; ``step[s]`` maps a word's number to the next state, ``link[s]`` is the state of the longest
    suffix in another class, ``longest[s]`` the length of the state's longest sequence.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        coded = [(item, [self.number.setdefault(w, len(self.number)) for w in text]) for item, text in items if text]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.items: dict[int, set] = {}  # by the state of a full window
        self.whole: dict[int, dict[int, set]] = {}  # by state and length: items shorter than a window
        for item, sequence in coded:
            self._note(item, sequence)
        self.shortest = min([window, *(len(s) for _, s in coded)]) if coded else 0
        self.next_whole = [-1] * len(self.step)
        for state in sorted(range(len(self.step)), key=self.longest.__getitem__):
            if state in self.whole:
                self.next_whole[state] = state
            elif state:
                self.next_whole[state] = self.next_whole[self.link[state]]

    def _state(self, step: dict[int, int], link: int, longest: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.step) - 1

    def _split(self, state: int, word: int, below: int) -> int:
        """The state of the sequences of ``below`` that reach no further back than ``state`` and the word."""
        if self.longest[below] == self.longest[state] + 1:
            return below
        twin = self._state(dict(self.step[below]), self.link[below], self.longest[state] + 1)
        self.link[below] = twin
        while state >= 0 and self.step[state].get(word) == below:
            self.step[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # another item already has this sequence
            return self._split(last, word, self.step[last][word])
        new = self._state({}, 0, self.longest[last] + 1)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.step[state][word])
        return new

    def _suffix(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a sequence in ``state``."""
        while self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _note(self, item: int | None, sequence: list[int]) -> None:
        state = 0
        for at, word in enumerate(sequence, 1):
            state = self.step[state][word]
            if at >= self.window:
                state = self._suffix(state, self.window)
                self.items.setdefault(state, set()).add(item)
        if len(sequence) < self.window:
            state = self._suffix(state, len(sequence))
            self.whole.setdefault(state, {}).setdefault(len(sequence), set()).add(item)

    def walk(self, sequence: list[int], begin: int, hits: list[tuple[int, int, int]], items: set) -> None:
        """Add (first word, end, longest match) of the occurrences in a run of known words that starts at ``begin``."""
        step, link, longest, window = self.step, self.link, self.longest, self.window
        state = length = 0
        for at, word in enumerate(sequence, begin + 1):
            while state and word not in step[state]:
                state = link[state]
                length = longest[state]
            if word not in step[state]:
                continue
            state = step[state][word]
            length += 1
            if length >= window:
                hits.append((at - window, at, length))
                items |= self.items[self._suffix(state, window)]
            whole = self.next_whole[state]
            while whole >= 0:
                for size, found in self.whole[whole].items():
                    if size <= length:
                        hits.append((at - size, at, length))
                        items |= found
                whole = self.next_whole[link[whole]] if whole else -1

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int, int]], set]:
        """Merged hit spans (first word, end, longest match) of a document, and the items with occurring windows."""
        hits: list[tuple[int, int, int]] = []
        items: set = set()
        if not self.shortest or len(text) < self.shortest:
            return hits, items
        numbers = np.fromiter((self.number.get(w, -1) for w in text), np.int64, len(text))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], numbers >= 0, [False])).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin >= self.shortest:
                self.walk(numbers[begin:end].tolist(), begin, hits, items)
        return merged(hits), items


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping or touching spans as one, with the largest of their lengths."""
    out: list[tuple[int, int, int]] = []
    for first, end, length in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(length, out[-1][2]))
        else:
            out.append((first, end, length))
    return out


@lru_cache(maxsize=1)
def _automaton(broadcast_id: int, window: int, broadcast) -> Automaton:
    return Automaton([(item, words(text)) for item, text in broadcast.value], window)


_FOUND = "n_words long, spans array<struct<first: long, end: long, longest: long>>, items array<long>"


def _pass(docs: DataFrame, shard: DataFrame, window: int) -> DataFrame:
    """(doc_id, tie, n_words, spans, items) of all documents against the items of one shard."""
    items = [(r[0], bytes(r[1])) for r in shard.collect()]  # bounded by SHARD_CHARS
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.id if hasattr(sent, "id") else id(sent), window, sent)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("longest", pa.int64())]))
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column(2).to_pylist():
                text = words(text or b"")
                hits, of = automaton.find(text)
                counts.append(len(text))
                spans.append([dict(zip(("first", "end", "longest"), h)) for h in hits])
                found.append(sorted(i for i in of if i is not None))
            yield record_batch(doc_id=batch.column(0), tie=batch.column(1), n_words=pa.array(counts, pa.int64()),
                               spans=pa.array(spans, kind), items=pa.array(found, pa.list_(pa.int64())))

    return map_batches(docs, scan, f"doc_id long, tie long, {_FOUND}")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, tie, n_words, spans, items) of every row of documents (doc_id, text).

    ``spans`` are disjoint word ranges with the longest match in each, ``items`` the sorted ids of items with occurring
    windows, ``tie`` a hash of the text that tells rows of one doc_id apart.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("tie"),
                       F.col("text").cast("binary").alias("text"))
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_chars))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    passes = [_pass(rows, items.where(shard == k).select("item_id", F.col("text").cast("binary")), window)
              for k in range(shards)]
    if shards == 1:
        return passes[0]
    first, *others = (stage(p) for p in passes)
    more = others[0]
    for other in others[1:]:
        more = more.unionByName(other)
    more = (more.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t"))
            .agg(F.flatten(F.collect_set("spans")).alias("s"), F.flatten(F.collect_set("items")).alias("i")))
    both = first.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    spans = F.when(F.col("s").isNull(), F.col("spans")).otherwise(_merged(F.concat("spans", "s")))
    items = F.when(F.col("i").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "i"))))
    return both.select("doc_id", "tie", "n_words", spans.alias("spans"), items.alias("items"))


def _merged(spans):
    """``merged`` for a column."""
    def add(out, x):
        last = F.element_at(out, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"),
                          F.greatest(last["longest"], x["longest"]).alias("longest"))
        overlaps = (F.size(out) > 0) & (x["first"] <= F.try_element_at(out, F.lit(-1))["end"])
        return F.when(overlaps, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(out, F.array(x)))

    empty = F.array().cast("array<struct<first:bigint,end:bigint,longest:bigint>>")
    return F.aggregate(F.sort_array(spans), empty, add)


def n_hit(spans: str = "spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def contaminated(n_hit_column, n_words):
    """At least a twentieth of the words is hit."""
    return (n_hit_column > 0) & (20 * n_hit_column >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns; hit spans of the others are cut out of the text.

    Character counts (a column ``n_chars``, if there is one) follow the cut text. Rows are matched to their findings by
    doc_id and text; a document without hits keeps its text as it is.
    """
    found = find(docs, benchmark, window).where(F.size("spans") > 0).dropDuplicates(["doc_id", "tie"])
    found = stage(found.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "n_words", "spans"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("d")) & (text_key(F.col("row.text")) == F.col("t"))
    joined = row.join(found, same, "left").where(F.col("d").isNull() & F.col("t").isNull()
                                                 | ~contaminated(n_hit(), F.col("n_words")))
    cut = joined.select("row", F.when(F.col("t").isNull(), F.col("row.text")).otherwise(
        without_spans(F.col("row.text"), F.col("spans"))).alias("cut"))
    columns = [F.col("cut").alias(c) if c == "text"
               else F.when(F.col("cut").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(
                   F.char_length("cut").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
               else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*columns)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between words of one span."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept, begin = [], 0
    for first, end in spans:
        kept.append(text[begin:at[first][0]])
        begin = at[end - 1][1]
    return b"".join([*kept, text[begin:]])


def without_spans(text, spans):
    """Column form of ``cut_words``; it runs on rows with spans only, as the others are not sent."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, ranges):
        return texts.combine(ranges, lambda t, r: t if t is None or r is None else cut_words(
            t.encode(), [(s["first"], s["end"]) for s in r]).decode())

    return cut(text, spans)


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
