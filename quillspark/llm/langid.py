"""Language identification by hierarchical discrimination.

A text is first assigned to a language family by one-versus-rest linear
support vector machines, then to a language of that family by a vote of
one-versus-one linear machines, trained for each pair of languages in it.

Features are relative frequencies of hashed character trigrams, which makes
every machine's score a mean of per-trigram weights: scoring a text is one
table lookup per character and machine, over the whole text.

Training uses about ``max_train`` labelled rows (a documented bound, drawn by a
hash of the document's id, so the draw doesn't depend on partitioning).  Each
language has the same quota of them, and all its rows where it has fewer.

Defined results
    null or empty text, text without a letter: rejected, ``lang_pred`` null.
    text that shares under ``min_known`` of its trigrams with the training
    text: rejected as in no known language, ``lang_pred`` null.
    a vote that ties: the tied language with the larger summed margin, then
    the first by name.
    no labelled rows at all: every row is rejected.  One language only: every
    known text is of it.  Null labels aren't trained on.
    repeated rows: each is judged by itself.  Extra columns: ignored by
    ``identify``, kept by ``filter_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ca", "ro", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("pl", "cs", "sk", "ru", "uk", "bg", "hr", "sr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}
BITS = 12
KNOWN_BITS = 20
MAX_TRAIN = 3000
MIN_KNOWN = 0.4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's index) of each character trigram that holds a letter; what isn't a letter counts as one space."""
    t = K.tables()
    c = K.Codes(texts)
    code = c.clipped()
    letter = t["word"][code] & ~((code >= 48) & (code <= 57)) & (code != 95)
    space = np.uint64(0x51ED270B153A4F2F)
    h = np.where(letter, t["hash"][code], space)
    pad = np.concatenate(([space], h, [space]))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (code[1:] != 10)
    g = K.mix(pad[:-2] * _M1 + pad[1:-1] * _M2 + pad[2:])
    doc = np.repeat(np.arange(len(texts)), c.length + 1)[: len(code)]
    return g[keep], doc[keep]


@dataclass
class Machines:
    """weights: a row for each machine, over 2**BITS features; bias to match."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    pairs: list[list[tuple[int, int]]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    known: np.ndarray = field(default_factory=lambda: np.zeros(1 << KNOWN_BITS, bool))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each machine's score of each text; the number of its trigrams; the share of them that is known."""
        g, doc = trigrams(texts)
        n = np.bincount(doc, minlength=len(texts))
        known = np.bincount(doc, self.known[g >> np.uint64(64 - KNOWN_BITS)], len(texts)) / np.maximum(n, 1)
        f = (g & np.uint64((1 << BITS) - 1)).astype(np.int64)
        out = np.empty((len(self.weights), len(texts)))
        for k, w in enumerate(self.weights):
            out[k] = np.bincount(doc, w[f], len(texts)) / np.maximum(n, 1) + self.bias[k]
        return out, n, known

    def predict(self, texts: list[str], min_known: float = MIN_KNOWN) -> list[tuple[str | None, str | None, float, bool]]:
        """(family, language, margin, rejected) of each text."""
        s, n, known = self.scores(texts)
        out = []
        nf = len(self.families)
        for d in range(len(texts)):
            if not nf or not n[d] or known[d] < min_known:
                out.append((None, None, 0.0, True))
                continue
            f = int(np.argmax(s[:nf, d]))
            langs = self.members[f]
            votes, sums, at = np.zeros(len(langs)), np.zeros(len(langs)), nf + sum(len(p) for p in self.pairs[:f])
            margin = float(s[f, d])
            for k, (a, b) in enumerate(self.pairs[f]):
                m = s[at + k, d]
                votes[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
            best = min(range(len(langs)), key=lambda i: (-votes[i], -sums[i], langs[i]))
            if len(langs) > 1:
                margin = float(sums[best] / (len(langs) - 1))
            out.append((self.families[f], langs[best], margin, False))
        return out


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps; classes weigh the same."""
    n, d = x.shape
    pos = max(1, int((y > 0).sum()))
    share = np.where(y > 0, 0.5 / pos, 0.5 / max(1, n - pos)).astype(np.float32)
    w, b = np.zeros(d, np.float32), np.float32(0)
    vw, vb = w.copy(), b
    lam = np.float32(1e-3 / c)
    step = np.float32(0.5 / (np.einsum("ij,ij,i->", x, x, share) + 1 + lam))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb))
        g = -2 * share * slack * y
        nw, nb = vw - step * (x.T @ g + lam * vw), vb - step * g.sum()
        mom = np.float32(k / (k + 3))
        vw, vb = nw + mom * (nw - w), nb + mom * (nb - b)
        w, b = nw, nb
    return w, float(b)


def fit_rows(texts: list[str], langs: list[str]) -> Machines:
    """Machines from labelled texts; texts without a trigram are left out."""
    m = Machines()
    rows, labels = [], []
    for a, b, part in K.text_chunks(list(texts)):
        g, doc = trigrams(part)
        m.known[g >> np.uint64(64 - KNOWN_BITS)] = True
        f = (g & np.uint64((1 << BITS) - 1)).astype(np.int64)
        n = np.bincount(doc, minlength=len(part))
        for d, (lo, hi) in enumerate(zip(np.searchsorted(doc, np.arange(len(part))), np.searchsorted(doc, np.arange(len(part)), "right"))):
            if n[d]:
                rows.append((np.bincount(f[lo:hi], minlength=1 << BITS) / n[d]).astype(np.float32))
                labels.append(langs[a + d])
    if not rows:
        return m
    x, y = np.stack(rows), np.array(labels)
    del rows
    scale = 1 / (x.std(0) + 1e-4)
    x *= scale
    present = sorted(set(labels))
    fam = {l: FAMILIES.get(l, f"other-{l}") for l in present}
    m.families = sorted(set(fam.values()))
    m.members = [[l for l in present if fam[l] == f] for f in m.families]
    weights, bias = [], []

    def add(rows: np.ndarray, sign: np.ndarray) -> None:
        w, b = _svm(x[rows] if not rows.all() else x, sign.astype(np.float32))
        weights.append(w * scale)
        bias.append(b)

    family = np.array([fam[l] for l in y])
    every = np.ones(len(y), bool)
    for f in m.families:
        add(every, np.where(family == f, 1, -1))
    for langs_ in m.members:
        p = [(i, j) for i in range(len(langs_)) for j in range(i + 1, len(langs_))]
        m.pairs.append(p)
        for i, j in p:
            rows_ = (y == langs_[i]) | (y == langs_[j])
            add(rows_, np.where(y[rows_] == langs_[i], 1, -1))
    m.weights, m.bias = np.stack(weights).astype(np.float32), np.array(bias, np.float32)
    return m


def quota(sizes: list[int], total: int) -> int:
    """The most rows a language, one at least, so that all languages together have no more than total."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left -= n
    return max(sizes, default=1)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Machines:
    """Machines from at most max_train of the rows that have a text and a `lang`."""
    labelled = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if sum(sizes.values()) > max_train:
        most = quota(list(sizes.values()), max_train)
        rate = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, min(1 << 30, int(most / n * (1 << 30))))))
        drawn = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
        labelled = labelled.filter(F.pmod(drawn, F.lit(1 << 30)) < rate[F.col("lang")])
    rows = labelled.select("text", "lang").limit(2 * max_train).collect()
    return fit_rows([r[0] for r in rows], [r[1] for r in rows])


def _judge(batch: pa.RecordBatch, m: Machines, min_known: float) -> list[tuple]:
    out: list[tuple] = []
    for _, _, part in K.text_chunks(batch.column("text").to_pylist()):
        out += m.predict(part, min_known)
    return out


def identify(docs: DataFrame, max_train: int = MAX_TRAIN, min_known: float = MIN_KNOWN, machines: Machines | None = None) -> DataFrame:
    """doc_id, family, lang_pred, margin, rejected for each row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(machines or fit(docs, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _judge(b, shared.value, min_known)
            cols = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                ["doc_id", "family", "lang_pred", "margin", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, family string, lang_pred string, margin double, rejected boolean")


def filter_known(docs: DataFrame, max_train: int = MAX_TRAIN, min_known: float = MIN_KNOWN, machines: Machines | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text is in a known language."""
    shared = docs.sparkSession.sparkContext.broadcast(machines or fit(docs, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not g[3] for g in _judge(b, shared.value, min_known)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
