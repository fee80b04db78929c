"""Token ids of texts by a tokenizer file, with a bounded memo of words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

MEMO_WORDS = 1_000_000
MEMO_WORD_BYTES = 64
#: Words encoded in one call, and what stands between those there that are not letters alone; words that contain it are encoded alone.
JOINED_WORDS = 256
SEPARATOR = "|"
#: Bytes of texts whose new words are looked up together.
GROUP_BYTES = 1 << 20


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each frequent word only once.

    Usable with tokenizers that drop white space, so that a text's ids are those of its pieces between spaces and line
    feeds, one after the other. Where the tokenizer ignores case, ASCII capitals are made small first, and where it cuts punctuation off,
    a new word is looked up without a full stop or comma at its end. Texts that hold the string of a special token in any
    case are encoded whole, as the library has it by default. At most ``MEMO_WORDS`` words
    are remembered, the older half of which goes when they are reached, but for words that were met again; longer words than ``MEMO_WORD_BYTES`` never are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if any(not s or " " in s or "\n" in s for s in special):
            raise ValueError("added tokens with white space; texts cannot be encoded word by word")
        self._special = re.compile("|".join(map(re.escape, special)).encode(), re.IGNORECASE) if special else None
        self._common = os.path.commonprefix(special).encode() if special and special == [s.lower() for s in special] else b""
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.code = "H" if max(vocabulary.values(), default=0) < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        if self._ids(["a b\nc"]) != [b"".join(self._ids(["a", "b", "c"]))]:
            raise ValueError("this tokenizer keeps white space; texts cannot be encoded word by word")
        self._plain = self._ids(["Ab's, A. b"]) == [b"".join(self._ids(["ab's", ",", "a", ".", "b"]))]
        #: ids of tokens that end a word, by their mark
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._memo: dict[bytes, bytes] = {b"": b""}
        self._old: dict[bytes, bytes] = {}
        self._separator = np.frombuffer(self._ids([SEPARATOR])[0], self.dtype)[0]
        self._marks = dict(zip((b".", b","), self._ids([".", ","])))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes()
                for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, words: list[str], between: str) -> list[bytes] | None:
        """Ids of words, many in one call: the separator's id, or a token that ends a word, tells where one ends."""
        out = []
        for begin in range(0, len(words), JOINED_WORDS):
            part = words[begin:begin + JOINED_WORDS]
            ids = np.frombuffer(self._ids([between.join([*part, ""])])[0], self.dtype)
            ends = np.flatnonzero(self._ends[ids] if between == " " else ids == self._separator)
            if len(ends) != len(part):
                return None
            data, step = ids.tobytes(), self.dtype.itemsize
            begins = [0, *((ends[:-1] + 1) * step).tolist()]
            out += [data[a:b] for a, b in zip(begins, ((ends + (between == " ")) * step).tolist())]
        return out

    def _encoded(self, words: list[str]) -> list[bytes]:
        if self._plain:
            found = self._cut(words, " ") if all(map(str.isalpha, words)) else self._cut(words, f" {SEPARATOR} ")
            if found is not None:
                return found
        return self._ids(words)

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the newer half of the memo lacks."""
        memo, old, marks = self._memo, self._old, self._marks
        known: dict[bytes, bytes] = {}
        open_words, new = [], set()
        for w in words:
            ids = old.get(w)
            if ids is None:
                part, mark = w, b""
                if self._plain and w[-1:] in marks and w[-2:-1].isalpha():
                    part, mark = w[:-1], marks[w[-1:]]
                    ids = memo.get(part) or old.get(part)
                    if ids is not None:
                        known[w] = ids + mark
                        continue
                open_words.append((w, part, mark))
                new.add(part)
            else:
                known[w] = ids
        letters, others, alone = [], [], []
        for part in new:
            text = part.decode()
            (letters if text.isalpha() else alone if SEPARATOR in text else others).append(text)
        found: dict[bytes, bytes] = {}
        for group, ids in ((letters, self._encoded(letters)), (others, self._encoded(others)), (alone, self._ids(alone))):
            found.update(zip(map(str.encode, group), ids))
        for w, part, mark in open_words:
            known[w] = found[part] + mark
        memo.update((w, ids) for w, ids in known.items() if len(w) <= MEMO_WORD_BYTES)
        return known

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned integers of ``dtype``."""
        return next(self.encode_all([(text or "").encode()]))

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text (UTF-8); the new words of about ``GROUP_BYTES`` bytes of texts are looked up together."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end] or b"") <= GROUP_BYTES):
                size += len(texts[end] or b"")
                end += 1
            yield from self._encode_group([t or b"" for t in texts[begin:end]])
            begin = end

    def _whole(self, text: bytes) -> bool:
        return bool(self._special and (not self._common or self._common in text) and self._special.search(text))

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        if len(self._memo) > MEMO_WORDS // 2:
            self._memo, self._old = {b"": b""}, self._memo
        get = self._memo.get
        words = [[] if self._whole(t) else (t.lower() if self._plain else t).replace(b"\n", b" ").split(b" ") for t in texts]
        ids = [list(map(get, of)) for of in words]
        new = [[i for i, known in enumerate(of) if known is None] if None in of else () for of in ids]
        found = self._learn({of[i] for of, places in zip(words, new) for i in places})
        for of, known, places in zip(words, ids, new):
            for i in places:
                known[i] = found[of[i]]
        return [b"".join(known) if of else self._ids([text.decode()])[0] for of, known, text in zip(words, ids, texts)]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
