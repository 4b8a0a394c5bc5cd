"""Vectorised text primitives shared by the corpus operators.

Everything here works on lists of Python strings and returns flat numpy
arrays, so that an Arrow batch is tokenised without a Python-level loop over
tokens. A *token* is a maximal run of Unicode letters and digits, lower-cased
character by character. Its 64-bit hash is a polynomial over its code points,
finalised with an integer mixer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18


@cache
def _fold(classes: str) -> np.ndarray:
    """Code point -> lower-cased code point if its category starts with one of *classes*, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in classes:
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def word_table() -> np.ndarray:
    return _fold("LN")


def letter_table() -> np.ndarray:
    return _fold("LM")


_powers: dict[int, np.ndarray] = {}


def _pow_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK), base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit integer hash (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Tokens:
    """Tokens of several texts: hash, and character span within the joined text.

    ``first[i]:first[i+1]`` are the tokens of text *i*; ``base[i]`` is where
    text *i* starts in the joined text.
    """

    __slots__ = ("base", "end", "first", "hash", "start")

    def __init__(self, texts: list[str]):
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])
        low = word_table()[code_points("\n".join(texts))]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (low != 0).view(np.int8), [0]])))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = np.empty(len(self.start), U64)
        i, n = 0, len(self.start)
        while i < n:
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + _BLOCK, "right")))
            width = int(self.end[j - 1] - a)
            pre = np.empty(width + 1, U64)
            pre[0] = 0
            np.cumsum(low[a : a + width].astype(U64) * _pow_table(_BASE, width)[:width], out=pre[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            self.hash[i:j] = (pre[e] - pre[s]) * _pow_table(_INVERSE, width)[s]
            i = j
        self.hash = mix(self.hash)
        self.first = np.searchsorted(self.start, self.base)

    def text_of_token(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_words(words: list[str]) -> np.ndarray:
    """Hash of each given token (already one token each)."""
    t = Tokens(words)
    if len(t.hash) != len(words):
        raise ValueError("each word must be exactly one token")
    return t.hash


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of *k* consecutive token hashes; length ``len(h)-k+1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0x100000001B3)
        out += h[j : j + n]
    return mix(out)


def byte_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose bytes stay under *limit* (a longer row stands alone)."""
    n = len(column)
    if not n:
        return
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64))
    a, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > a and total + s > limit:
            yield a, i
            a, total = i, 0
        total += s
    yield a, n


def texts_of(column: pa.Array, a: int, b: int) -> list[str]:
    """Rows a..b as strings; NULL counts as the empty text."""
    return [t or "" for t in column.slice(a, b - a).to_pylist()]
