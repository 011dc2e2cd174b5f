"""Exact tokenisation with a bounded per-worker cache of words.

The vocabulary used here drops white space and never merges across its own word boundaries, so a
text's ids are the concatenation of the ids of its words. Encoding each distinct word once with
the library and joining cached bytes gives the library's ids at a fraction of its time.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

#: Entries a worker keeps in each of two generations, so its memory stays bounded.
CACHE_LIMIT = 240_000
#: Longer entries are encoded each time and never kept.
KEPT_LENGTH = 48
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 2_000_000

#: Texts of these characters alone are stable under NFC and lower-case letter by letter, so their
#: words are known before the library sees them. Angle brackets could spell a special token.
_PLAIN = re.compile(r"[\t\n\r -;=?-~\xc0-\xff]*")
#: The vocabulary's own words: contractions, runs of letters, single digits, runs of other marks.
_WORD = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 stands for itself, the other bytes
    follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BoundedCache(dict):
    """Fills itself on a miss. At the limit the entries become the old generation, from which
    those still in use come back without being computed again."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value

    def empty(self) -> None:
        self.clear()
        self._old = {}


class WordEncoder:
    """Texts to little-endian uint32 ids, equal to the library's for every text."""

    def __init__(self, path: str, limit: int = CACHE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._alphabet = byte_alphabet()
        self._words = BoundedCache(self._word, limit // 4)
        self._chunks = BoundedCache(self._chunk, limit)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._alphabet)
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Of a plain chunk. Capitals and a closing mark are taken off first: the bare word is
        mostly known already."""
        if chunk.isalpha():
            low = chunk.lower()
            return self._word(low) if low == chunk else self._chunks[low]
        if chunk[-1] in ".," and chunk[-2:-1].isalnum():
            return self._chunks[chunk[:-1]] + self._words[chunk[-1]]
        return b"".join(map(self._words.__getitem__, _WORD.findall(chunk.lower())))

    def encode_one(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._chunks.__getitem__, text.split()))
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]

    def forget(self) -> None:
        """Empties the caches; the loaded vocabulary stays."""
        self._words.empty()
        self._chunks.empty()


@cache
def shared_encoder(path: str, limit: int = CACHE_LIMIT) -> WordEncoder:
    """The worker process's encoder: its caches stay warm from one task to the next, unless the task
    makes it forget them."""
    return WordEncoder(path, limit)


def grouped(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``chars`` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]
