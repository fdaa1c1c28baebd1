"""Texts as arrays of code points: words, their hashes and counts per text with a few NumPy passes, no Python per character."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

LIMIT = 0x30000  # code points from here on are never word characters
CHUNK = 1 << 18
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_made: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    return x * _U(0x94D049BB133111EB)


def lookup() -> dict[str, np.ndarray]:
    """Per process and by code point: word character (marks too), white space, simple lower case, hash."""
    if "word" not in _made:
        every = ["￾" if 0xD800 <= c <= 0xDFFF else chr(c) for c in range(LIMIT + 1)]
        word = np.zeros(LIMIT + 1, bool)
        joined = "".join(every)
        word[[m.start() for m in re.finditer(r"\w", joined)]] = True
        word[[i for i, c in enumerate(every) if not word[i] and unicodedata.category(c)[0] == "M"]] = True
        space = np.zeros(LIMIT + 1, bool)
        space[[m.start() for m in re.finditer(r"\s", joined)]] = True
        low = np.fromiter((ord(l) if len(l := c.lower()) == 1 else ord(c) for c in every), np.uint32, LIMIT + 1)
        word[LIMIT] = space[LIMIT] = False
        _made.update(word=word, space=space, low=low, hash=_mixed(low.astype(np.uint64)))
    return _made


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pw" not in _made or len(_made["pw"]) < n:
        m = 1 << max(CHUNK, n - 1).bit_length()
        for name, base in (("pw", _BASE), ("ipw", _INVERSE)):
            out, done, step = np.ones(m, np.uint64), 1, base
            while done < m:
                out[done : 2 * done] = out[:done] * _U(step)
                step, done = step * step % (1 << 64), 2 * done
            _made[name] = out
    return _made["pw"], _made["ipw"]


def marked(chars: str) -> np.ndarray:
    """Table of the code points that a string holds."""
    t = np.zeros(LIMIT + 1, bool)
    t[[ord(c) for c in chars]] = True
    return t


class Points:
    """The code points of texts, each after a line feed and the last before one, and the words among them."""

    def __init__(self, texts: Sequence[str]):
        t = lookup()
        self.n = len(texts)
        joined = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code = np.minimum(code, np.uint32(LIMIT))
        self.length = np.fromiter(map(len, texts), np.int64, self.n)
        self.first = 1 + np.cumsum(self.length + 1) - self.length - 1
        edge = np.diff(t["word"][self.code].astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        n = len(self.code)
        pw, self.ipw = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(t["hash"][self.code] * pw[:n], out=self.prefix[1:])
        self.capitals = np.zeros(n + 1, np.int64)
        np.cumsum(t["low"][self.code] != self.code, out=self.capitals[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the lower-cased code points from start to end."""
        return _mixed((self.prefix[end] - self.prefix[start]) * self.ipw[start] + (end - start).astype(np.uint64))

    def per_text(self, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """How many of the places lie in each text."""
        doc = np.searchsorted(self.first, at, "right") - 1
        return np.bincount(doc, weight, self.n).astype(np.int64)


def hashed(words: Sequence[str]) -> np.ndarray:
    p = Points(words)
    return p.hashes(p.first, p.first + p.length)


def chunks(texts: Iterable[str], limit: int = CHUNK) -> Iterator[list[str]]:
    """Texts in runs of about `limit` characters; a longer one stands alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


class Spellings:
    """Words, some standing for all that begin with them (ending in \\w*), compared in lower case or as they are with one capital at most, their first."""

    def __init__(self, words: Sequence[str], folded: bool):
        self.folded = folded
        open_ = [w.removesuffix(r"\w*") for w in words if w.endswith(r"\w*")]
        plain = [v for w in words if not w.endswith(r"\w*") for v in ([w[:-2], w[:-1]] if w.endswith("?") else [w])]
        self.whole = np.sort(hashed(plain)) if plain else np.zeros(0, np.uint64)
        self.heads = {n: np.sort(hashed([w for w in open_ if len(w) == n])) for n in {len(w) for w in open_}}
        self.small = not folded and all(w == w.lower() for w in words)

    def __call__(self, p: Points, hashes: np.ndarray) -> np.ndarray:
        """Whether each word of the points is one of these."""
        size = p.end - p.start
        out = self._cased(p, np.isin(hashes, self.whole), size)
        for n, keys in self.heads.items():
            at = np.flatnonzero(size >= n)
            hit = at[np.isin(p.hashes(p.start[at], p.start[at] + n), keys)]
            found = np.zeros(len(size), bool)
            found[hit] = True
            out |= self._cased(p, found, np.full(len(size), n))
        return out

    def _cased(self, p: Points, hit: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.folded:
            return hit
        at = np.flatnonzero(hit)
        s = p.start[at]
        capitals = p.capitals[s + size[at]] - p.capitals[s]
        first = p.capitals[s + 1] - p.capitals[s]
        hit[at] = (capitals == 0) if self.small else (capitals == 1) & (first == 1)
        return hit
