"""Vectorised text kernel shared by the operators of this subpackage.

A batch of texts is laid out as one array of code points; words, their
64-bit hashes and their n-grams are then found with a handful of NumPy
passes, so that no Python code runs per character or per word.

A word is a maximal run of alphanumeric code points or underscores, compared
in lower case (the simple one-to-one mapping).  Null texts count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

from quillspark.sources.tables import shared_folder

LIMIT = 0x30000  # code points from here on are never word characters
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64
CHUNK_CHARS = 1 << 17
KEPT = 1 << 18

_tables: dict[str, np.ndarray] = {}
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True) if x.dtype != np.uint64 else x.copy()
    x += _MUL
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def tables() -> dict[str, np.ndarray]:
    """Per-process lookup tables over code points, made once."""
    if "word" not in _tables:
        surrogate = lambda c: 0xD800 <= c <= 0xDFFF
        every = [" " if surrogate(c) else chr(c) for c in range(LIMIT)]
        low = np.fromiter((ord(l) if len(l := c.lower()) == 1 else ord(c) for c in every), np.uint32, LIMIT)
        low = np.append(low, np.uint32(0x20))
        word = np.zeros(LIMIT + 1, bool)
        word[[m.start() for m in re.finditer(r"\w", "".join(every))]] = True
        _tables.update(low=low, word=word, hash=mix(low.astype(np.uint64)))
    return _tables


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept for the process only up to KEPT, which nearly all texts are under."""
    have = _powers.get("pw")
    if have is not None and len(have) >= n:
        return have, _powers["ipw"]
    m = max(KEPT, 1 << int(n - 1).bit_length())
    made = []
    for base in (_BASE, _BASE_INV):
        out = np.empty(m, np.uint64)
        out[0] = 1
        done, step = 1, base
        while done < m:
            out[done : 2 * done] = out[:done] * _U(step)
            step = step * step % (1 << 64)
            done *= 2
        made.append(out)
    if m == KEPT:
        _powers["pw"], _powers["ipw"] = made
    return made[0], made[1]


class Codes:
    """Code points of a run of texts, joined by line feeds that belong to none of them."""

    __slots__ = ("text", "code", "first", "length")

    def __init__(self, texts: Sequence[str]):
        self.text = "\n".join(texts)
        self.code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.length + 1) - self.length - 1

    def clipped(self) -> np.ndarray:
        return np.minimum(self.code, np.uint32(LIMIT)) if len(self.code) and self.code.max() > LIMIT else self.code


class Words:
    """Words of a run of texts: for each its text's index, its span in the joined code points, its hash."""

    __slots__ = ("codes", "doc", "start", "end", "hash", "prefix", "n_docs", "first")

    def __init__(self, texts: Sequence[str]):
        t = tables()
        self.codes = c = Codes(texts)
        code = c.clipped()
        n = len(code)
        self.n_docs = len(texts)
        flags = np.zeros(n + 2, np.int8)
        flags[1:-1] = t["word"][code]
        edge = np.diff(flags)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        pw, ipw = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(t["hash"][code] * pw[:n], out=self.prefix[1:])
        self.hash = self.span_hash(self.start, self.end)
        self.doc = np.searchsorted(c.first, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the lower-cased code points from start to end."""
        _, ipw = powers(len(self.prefix))
        return mix((self.prefix[end] - self.prefix[start]) * ipw[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words within one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, gram_hash(self.hash, at, n)

    def words_of(self, d: int) -> np.ndarray:
        return self.hash[self.first[d] : self.first[d + 1]]


def gram_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = words[at]
    for k in range(1, n):
        h = mix(h * _U(0xC2B2AE3D27D4EB4F) + words[at + k])
    return h


def hash_words(words: Sequence[str]) -> np.ndarray:
    """Hash of each string, which need not be a word, as Words would hash that span."""
    c = Words(words)
    return c.span_hash(c.codes.first, c.codes.first + c.codes.length)


def chunks(lengths: Sequence[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `limit` characters; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    clean = [t or "" for t in texts]
    for a, b in chunks([len(t) for t in clean], limit):
        yield a, b, clean[a:b]


def in_sorted(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in the sorted keys of each value, -1 where it is none of them."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    i = np.searchsorted(keys, values)
    i[i == len(keys)] = 0
    return np.where(keys[i] == values, i, -1)


def checkpoint_dir(spark) -> str:
    """The folder for checkpoints that all executors share; a cluster that names none is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df):
    """The frame cut from its lineage through the checkpoint folder that all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
