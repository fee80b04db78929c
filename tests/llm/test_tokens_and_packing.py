import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from forumlens.llm import packing, token_files, tokenize
from tests.llm.helpers import frame, odd_rows, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


PLAIN = plain()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé. ,'\ns!0中İΣ́ <|>endoftx"), max_size=60))
def test_words_encode_like_texts(text):
    assert list(np.frombuffer(tokenize.encoder(PATH).encode(text), "<u2")) == PLAIN(text)


def test_special_tokens_are_encoded_like_the_library_does():
    whole = Tokenizer.from_file(PATH)
    for text in ("a <|endoftext|> b", "x<|endoftext|>y, <|ENDOFTEXT|> <|endoftext|>. | <|startoftext|>\n<|endoftext|><|endoftext|>",
                 "<|ENDOFTEXT|>. <|endoftext|> <| endoftext |> <|endoftext", "<|endoftext|>", "  a  <|endoftext|>  \n b"):
        for _ in range(2):  # new words, then remembered ones
            assert list(np.frombuffer(tokenize.encoder(PATH).encode(text), "<u2")) == whole.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(tokenize.encoder(PATH).encode("a <|endoftext|> b"), "<u2")) == [320, 49407, 321]


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenize, "MEMO_WORDS", 6)
    small = tokenize.WordEncoder(PATH)
    for k in range(40):
        text = f"word{k} again. Again, {'long' * 40} word{k // 2}"
        assert list(np.frombuffer(small.encode(text), "<u2")) == PLAIN(text)


def test_tokenizers_that_keep_spaces_are_refused():
    with pytest.raises(ValueError):
        tokenize.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_files_hold_all_documents_in_order(spark):
    rows = odd_rows()
    dataset = token_files.write(frame(spark, rows), PATH, end_id=2, shards=4)
    assert dataset.width == 2 and dataset.manifest(spark).count() > 1
    got = token_files.read(spark, dataset).collect()
    expected = Counter((i, len(ids), crc(ids)) for i, t in texts(rows) for ids in [PLAIN(t) + [2]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1])
    numbers = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert numbers == sorted(numbers)


def test_an_empty_table(spark):
    empty = frame(spark, []).where("false")
    assert token_files.read(spark, token_files.write(empty, PATH, 2)).count() == 0
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("groups_of", [100_000, 5])
def test_pieces_fill_sequences(spark, monkeypatch, groups_of):
    rows = odd_rows()
    lengths = packing.stage(packing.pieces(frame(spark, rows), PATH, 0, 64))
    got = packing.pack(lengths, 64, groups_of).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(
        (i, k, 64 * k, len(ids[64 * k:64 * k + 64]), crc(ids[64 * k:64 * k + 64]))
        for i, t in texts(rows) for ids in [PLAIN(t) + [0]] for k in range(-(-len(ids) // 64)))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 64
        assert all(a + n == b for (a, n), (b, _) in pairwise(parts))


def brute_sum_of_squares(lengths, capacity):
    gaps, places = [], []
    for s in lengths:
        def cost(k):
            after = [g - s * (k == j) for j, g in enumerate(gaps)] + ([capacity - s] if k == len(gaps) else [])
            return sum(n * n for g, n in Counter(after).items() if g)
        fits = [k for k in range(len(gaps)) if gaps[k] >= s]
        options = sorted((cost(k), gaps[k], k) for k in fits) + [(cost(len(gaps)), capacity, len(gaps))]
        _, gap, k = min(options)
        places.append((k, capacity - gap))
        if k == len(gaps):
            gaps.append(capacity)
        gaps[k] -= s
    return places


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_each_piece_goes_where_the_squares_are_smallest(lengths):
    sequence, offset = packing.sum_of_squares(np.array(lengths, np.int64), 12)
    assert list(zip(sequence.tolist(), offset.tolist())) == brute_sum_of_squares(lengths, 12)


def test_few_sequences_beyond_the_least(spark):
    lengths = np.random.default_rng(1).integers(1, 700, 20_000)
    sequence, _ = packing.sum_of_squares(np.sort(lengths)[::-1], 2048)
    assert sequence.max() + 1 <= 1.01 * lengths.sum() / 2048 + 1
