"""Masked pseudo-likelihood: a bidirectional window network scores every token from both of its sides.

A token is a word.  Its conditional probability is that of its class, given
the classes of the WINDOW words before and after it (one hidden layer over
position-wise embeddings, trained in NumPy; the group of classes is predicted
first, then the class in it), times that of the word within its class (corpus
frequencies).  A document's score is the sum of the logarithms.

The classes and the width follow the corpus (Shape.of): about half of the
classes are single words, the most frequent ones, the others are buckets of
the words of a suffix.  A neighbour is put in another bucket than a predicted word, so
words that share one are still told apart by what stands around them.

Everything is gathered from all documents: the words are counted in one
shuffle and every word, however rare, has the probability of its own count,
which is joined to the words of each block of documents and never gathered in
one place.  Every token of every document is a training target: the documents
are dealt to ROUNDS rounds by a hash, in each round every share of about SHARE
tokens takes Adam steps from the common network, and the networks are averaged,
weighted by their tokens.  A small corpus is one share, gone over several times.

Texts are cut into words once: blocks of about BLOCK words are stored as
numbers into the block's own words in the shared checkpoint folder, and then
as two classes per word.

Defined results
    null or empty text, text without a word: tokens 0, log_likelihood 0, mean_log_prob null.
    very long texts: scored whole.  Beyond a text's ends the window holds a boundary class.
    repeated rows: each is scored (and counted in training), alike but for single-precision rounding.  Null doc_id: kept as null.
    empty table: no row.  Extra columns: ignored.  Ties in frequency: the smaller word hash comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

WINDOW = 2
TOP = 40
SUFFIXES = 23
CLASSES = 1 + TOP + SUFFIXES  # class 0 is the boundary
HIDDEN = 16
ROUNDS = 4
BATCH = 4096
RATE = 0.01
BLOCK = 1 << 20
SHARE = 3 << 20
STEPS = 500


@dataclass(frozen=True)
class Shape:
    """inputs: classes of the window's words; groups * members: classes of the predicted word, chosen by the group first."""

    inputs: int = CLASSES
    groups: int = 1
    members: int = CLASSES
    hidden: int = HIDDEN

    @staticmethod
    def of(tokens: int) -> "Shape":
        """Classes as the power 0.4 of the tokens, width as their sixth root."""
        m = max(12, int(np.ceil(tokens**0.2)))
        return Shape(m * m, m, m, max(HIDDEN, round(tokens ** (1 / 6))))

    @property
    def classes(self) -> int:
        return self.groups * self.members

    @property
    def buckets(self) -> int:
        """Classes of the words of one suffix."""
        return max(1, (self.classes - 1) // 2 // SUFFIXES)

    @property
    def top(self) -> int:
        """Most frequent words that are a class each."""
        return self.classes - 1 - SUFFIXES * self.buckets

    @property
    def arrays(self) -> tuple[tuple[int, ...], ...]:
        return (2 * WINDOW * self.inputs, self.hidden), (self.hidden,), (self.hidden, self.classes), (self.classes,), (self.hidden, self.groups), (self.groups,)


def batch_of(tokens: int) -> int:
    return min(4 * BATCH, max(BATCH // 4, tokens // 1000))


def suffix(w: K.Words) -> np.ndarray:
    """Hash class, under SUFFIXES, of each word's last two characters."""
    return (w.span_hash(np.maximum(w.start, w.end - 2), w.end) % np.uint64(SUFFIXES)).astype(np.int64)


# --- words ----------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Small whole numbers, compressed: all their low bytes, then all their second bytes, and so on."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    return np.frombuffer(np.frombuffer(pa.decompress(raw, 4 * n, "zstd"), np.uint8).reshape(4, n).T.tobytes(), "<u4")


class Dictionary:
    """The words of a block of documents, numbered as they first occur: their hashes, suffix classes and numbers of occurrences."""

    def __init__(self) -> None:
        self.sorted, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.hash: list[np.ndarray] = []
        self.suffix: list[np.ndarray] = []
        self.count = np.zeros(0, np.int64)
        self.tokens = 0

    def add(self, w: K.Words) -> np.ndarray:
        """The number of each word, after the new ones among them got theirs."""
        u, first, inv, c = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
        i = K.in_sorted(u, self.sorted)
        new = i < 0
        at = np.where(new, len(self.count) - 1 + np.cumsum(new), self.at[i] if len(self.at) else 0)
        self.hash.append(u[new])
        self.suffix.append(suffix(w)[first[new]])
        self.count = np.append(self.count, np.zeros(int(new.sum()), np.int64))
        self.count[at] += c
        self.tokens += len(inv)
        merged = np.concatenate([self.sorted, u[new]])
        order = np.argsort(merged, kind="stable")
        self.sorted, self.at = merged[order], np.concatenate([self.at, at[new]])[order]
        return at[inv]


def cut(docs: DataFrame) -> DataFrame:
    """A row for each document: block, doc_id, deal, n (words), ids (their packed numbers in the block); and one for each block's words: block, h, s, c."""

    def row(names: str, *cols: pa.Array) -> pa.RecordBatch:
        given = dict(zip(names.split(), cols))
        kinds = {"block": pa.int64(), "doc_id": pa.int64(), "deal": pa.int32(), "n": pa.int64(), "ids": pa.binary(), "h": pa.binary(), "s": pa.binary(), "c": pa.binary()}
        return pa.RecordBatch.from_arrays([given.get(n, pa.nulls(len(cols[0]), k)) for n, k in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, d = TaskContext.get().partitionId() << 32, Dictionary()

        def words() -> pa.RecordBatch:
            parts = (np.concatenate(d.hash).astype("<u8"), np.concatenate(d.suffix).astype(np.uint8), d.count.astype("<i8"))
            return row("block h s c", pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in parts))

        for batch in batches:
            for lo, hi, part in K.text_chunks(batch.column("text").to_pylist()):
                w = K.Words(part)
                at = d.add(w)
                ids = [pack(at[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
                doc_id, deal = (batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "deal"))
                yield row("block doc_id deal n ids", pa.array([block] * len(part)), doc_id, deal, pa.array(np.diff(w.first)), pa.array(ids, pa.binary()))
                if d.tokens >= BLOCK:
                    yield words()
                    block, d = block + 1, Dictionary()
        if d.hash:
            yield words()

    deal = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int").alias("deal")
    return docs.select(F.col("doc_id").cast("long"), deal, "text").mapInArrow(run, "block long, doc_id long, deal int, n long, ids binary, h binary, s binary, c binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """block, at, h, s, c: the words of each block of cut(), with their numbers in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *parts in zip(*(batch.column(n).to_pylist() for n in ("block", "h", "s", "c"))):
                h, s, c = (np.frombuffer(x, kind) for x, kind in zip(parts, ("<i8", np.uint8, "<i8")))
                for lo in range(0, len(h), 1 << 16):
                    n = len(h[lo : lo + (1 << 16)])
                    cols = (np.full(n, block), np.arange(lo, lo + n, dtype=np.int32), h[lo : lo + n], s[lo : lo + n].astype(np.int64), c[lo : lo + n])
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["block", "at", "h", "s", "c"])

    return blocks.filter("h is not null").select("block", "h", "s", "c").mapInArrow(run, "block long, at int, h long, s long, c long")


def total_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))


def count_words(docs: DataFrame) -> DataFrame:
    """h, s, c: each word's hash, suffix class and number of occurrences in all documents."""
    return total_counts(block_words(cut(docs)))


@dataclass
class Vocabulary:
    """The words that are classes (hashes, in the order of their classes), the number of tokens in each class, its log share of all."""

    top: np.ndarray
    mass: np.ndarray
    prior: np.ndarray
    shape: Shape

    def place(self, bits: int) -> Column:
        """Class of the word of columns h and s: its own, or that of its suffix and of its hash above the low bits."""
        return _place(self.top, self.shape, bits)


def _place(top: np.ndarray, shape: Shape, bits: int) -> Column:
    of = F.lit(1 + shape.top) + F.col("s") * shape.buckets + F.pmod(F.shiftrightunsigned("h", bits), F.lit(shape.buckets))
    if not len(top):
        return of.cast("long")
    own = F.create_map(*(F.lit(x) for k, h in enumerate(top.tolist()) for x in (h, 1 + k)))
    return F.coalesce(own[F.col("h")].cast("long"), of.cast("long"))


PREDICTED, SEEN = 8, 36  # a word is in unlike company as a predicted word and as a neighbour


def vocabulary(counts: DataFrame, shape: Shape | None = None) -> Vocabulary:
    """What the classes need; every word's own count stays in the distributed table."""
    shape = shape or Shape.of(counts.agg(F.sum("c")).first()[0] or 0)
    # as unsigned numbers, the larger half of the hashes is negative here
    top = np.array([r["h"] for r in counts.orderBy(F.desc("c"), F.expr("h < 0"), "h").limit(shape.top).collect()], np.int64)
    mass = np.zeros(shape.classes)
    for k, c in counts.groupBy(_place(top, shape, PREDICTED)).agg(F.sum("c")).collect():  # a row for each class
        mass[k] = c
    return Vocabulary(top, mass, np.log((mass + 0.5) / (mass.sum() + 0.5 * shape.classes)), shape)


def tokens(blocks: DataFrame, words: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, n, ids (packed: class as a neighbour, and 65,536 times that as a predicted word), within (sum of the words' log probabilities in their classes), deal of each document.

    Each block's words get their counts in all documents by a join on the hash; its documents then meet them by the block."""
    shared = blocks.sparkSession.sparkContext.broadcast(vocab.mass)
    known = words.select("block", "at", "h", "s").join(counts.select("h", "c"), "h")
    known = known.select("block", "at", vocab.place(PREDICTED).cast("int").alias("cls"), vocab.place(SEEN).cast("int").alias("seen"), "c")
    mine = blocks.filter("h is null").select("block", "doc_id", "deal", "n", "ids")

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        cls, seen, c = (table.column(x).to_numpy()[order] for x in ("cls", "seen", "c"))
        both = cls.astype(np.uint32) << np.uint32(16) | seen.astype(np.uint32)
        logp = np.log(c / shared.value[cls])
        ids, within = [], []
        for x, n in zip(docs.column("ids").to_pylist(), docs.column("n").to_pylist()):
            at = unpack(x, n)
            ids.append(pack(both[at]))
            within.append(float(logp[at].sum()))
        return pa.table([docs.column("doc_id"), docs.column("deal"), docs.column("n"), pa.array(ids, pa.binary()), pa.array(within, pa.float64())], ["doc_id", "deal", "n", "ids", "within"])

    return mine.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, deal int, n long, ids binary, within double")


# --- network ----------------------------------------------------------------------


def _normalise(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _pick(z: np.ndarray, at: np.ndarray, grad: bool) -> np.ndarray:
    """Log probability of one place a row; z becomes, where grad, the gradient of its negative."""
    one = np.arange(len(z))
    z -= z.max(1, keepdims=True)
    got = z[one, at]
    np.exp(z, out=z)
    total = z.sum(1)
    if grad:
        z /= total[:, None]
        z[one, at] -= 1
    return got - np.log(total)


@dataclass
class Network:
    """hidden = tanh(sum of the window's embedding rows + bias); scores = hidden @ out + out_bias within the group, that of the group likewise."""

    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    shape: Shape

    @staticmethod
    def fresh(prior: np.ndarray, seed: int = 7, shape: Shape = Shape()) -> "Network":
        r = np.random.default_rng(seed)
        s, h = shape.arrays, shape.hidden
        groups = np.log(np.exp(prior).reshape(shape.groups, -1).sum(1))
        made = r.normal(0, 0.3, s[0]), np.zeros(h), r.normal(0, 0.3, s[2]), prior, r.normal(0, 0.3, s[4]), groups
        return Network(*(x.astype(np.float32) for x in made), shape)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.bias, self.out, self.out_bias, self.group, self.group_bias)])

    @staticmethod
    def of(flat: np.ndarray, shape: Shape = Shape()) -> "Network":
        parts = np.split(np.asarray(flat, np.float32), np.cumsum([int(np.prod(s)) for s in shape.arrays])[:-1])
        return Network(*(p.reshape(s) for p, s in zip(parts, shape.arrays)), shape)

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        h = self.embed[rows[0]]
        for r in rows[1:]:
            h = h + self.embed[r]
        return np.tanh(h + self.bias)

    def log_probs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden, log probability of each class) for rows of the window's embedding rows."""
        h = self.hidden(rows)
        z = (h @ self.out + self.out_bias).reshape(-1, self.shape.members)
        of = _normalise(h @ self.group + self.group_bias)
        return h, (_normalise(z) + of.reshape(-1, 1)).reshape(len(h), -1)

    def of_targets(self, h: np.ndarray, target: np.ndarray, grad: bool = False) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]:
        """(log probability of each target, and where grad: gradient by h, gradients by out, out_bias, group, group_bias)."""
        m, n = self.shape.members, len(h)
        g = target // m
        logp = np.empty(n, np.float32)
        width = n if grad else BATCH
        for lo in range(0, n, max(1, width)):
            p = h[lo : lo + width] @ self.group + self.group_bias
            logp[lo : lo + width] = _pick(p, g[lo : lo + width], grad)
        order = np.argsort(g, kind="stable")
        edge = np.searchsorted(g[order], np.arange(self.shape.groups + 1))
        hs, pick, inner = h[order], (target - g * m)[order], np.empty(n, np.float32)
        if grad:
            p /= n
            dh, dhs, dout, dbias = p @ self.group.T, np.empty_like(hs), np.zeros_like(self.out), np.zeros_like(self.out_bias)
            last = [h.T @ p, p.sum(0)]
        for k in np.flatnonzero(np.diff(edge)):
            a, b, of = edge[k], edge[k + 1], slice(k * m, (k + 1) * m)
            p = hs[a:b] @ self.out[:, of] + self.out_bias[of]
            inner[a:b] = _pick(p, pick[a:b], grad)
            if grad:
                p /= n
                dhs[a:b], dout[:, of], dbias[of] = p @ self.out[:, of].T, hs[a:b].T @ p, p.sum(0)
        logp[order] += inner
        if not grad:
            return logp, None, []
        dh[order] += dhs
        return logp, dh, [dout, dbias, *last]


def layout(ids: list[bytes], kind: type = np.uint8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with WINDOW boundaries before and after each document, places of the words, each document's first place among them)."""
    wide = np.dtype(kind).itemsize
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // wide
    pad = bytes(WINDOW * wide)
    flat = np.frombuffer(pad + pad.join(ids) + pad, kind).astype(np.int64)
    first = np.append(0, np.cumsum(n))
    at = np.arange(int(n.sum())) + np.repeat(WINDOW * (1 + np.arange(len(ids))), n)
    return flat, at, first


def sides(flat: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(class as a neighbour, class as a predicted word) of ids, which are one for ids of a byte."""
    return (flat, flat) if np.dtype(kind).itemsize == 1 else (flat & 0xFFFF, flat >> 16)


def window_rows(flat: np.ndarray, at: np.ndarray, inputs: int = CLASSES) -> np.ndarray:
    offsets = [d for d in range(-WINDOW, WINDOW + 1) if d]
    return np.stack([flat[at + d] + k * inputs for k, d in enumerate(offsets)])


def train_share(net: Network, shares: Iterator[list[bytes]], kind: type = np.uint8, batch: int = BATCH, epochs: int = 1) -> tuple[np.ndarray, int]:
    """The network after a step of Adam for each batch of tokens of the shares, epochs times, and the number of tokens."""
    p = net.flat().astype(np.float32)
    m, v, seen, k = np.zeros_like(p), np.zeros_like(p), 0, 0
    shape, wide, lane = net.shape, net.shape.hidden, np.arange(net.shape.hidden)
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def step(rows: np.ndarray, target: np.ndarray) -> None:
        nonlocal k, m, v, p
        n = Network.of(p, shape)
        h = n.hidden(rows)
        _, dh, last = n.of_targets(h, target, grad=True)
        dh *= 1 - h * h
        size = shape.inputs * wide
        de = np.empty((2 * WINDOW, size), np.float32)
        for j, r in enumerate(rows):
            de[j] = np.bincount(((r - j * shape.inputs)[:, None] * wide + lane).ravel(), dh.ravel(), size)
        grad = np.concatenate([de.ravel(), dh.sum(0), *(x.ravel() for x in last)]).astype(np.float32)
        k += 1
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        p -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)

    for ids in shares:
        flat, at, _ = layout(ids, kind)
        near, target = sides(flat, kind)
        seen += len(at)
        for lo in range(0, len(at), batch):
            here = at[lo : lo + batch]
            one = window_rows(near, here, shape.inputs), target[here]
            if epochs > 1:
                kept.append(one)
            step(*one)
    for _ in range(epochs - 1):
        for one in kept:
            step(*one)
    return p, seen


def filled(parts: Iterator[list[bytes]], least: int) -> Iterator[list[bytes]]:
    """The parts, joined until they have at least so many bytes, but for the last."""
    kept: list[bytes] = []
    size = 0
    for ids in parts:
        for x in ids:
            kept.append(x)
            size += len(x)
            if size >= least:
                yield kept
                kept, size = [], 0
    if kept:
        yield kept


def unpacked(b: pa.RecordBatch) -> list[bytes]:
    return [unpack(x, n).tobytes() for x, n in zip(b.column("ids").to_pylist(), b.column("n").to_pylist())]


SLICE = 1 << 14


def train(rows: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network after all rounds over rows (deal, n, ids).

    What is trained one after the other follows the tokens: shares of about SHARE tokens, batches by the size of the corpus, and
    as many passes over a small one as give STEPS steps."""
    sc, shape, total = rows.sparkSession.sparkContext, vocab.shape, int(vocab.mass.sum())
    net, batch = Network.fresh(vocab.prior, shape=shape), batch_of(total)
    if not total:
        return net
    rounds = rounds if total > SHARE else 1
    shares = max(1, -(-total // (rounds * SHARE)))
    epochs = -(-STEPS // max(1, -(-total // (shares * batch)))) if shares == 1 else 1
    for r in range(rounds):
        shared = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p, n = train_share(shared.value, filled(map(unpacked, batches), 16 * batch), np.uint32, batch, epochs)
            if n:
                x = p.astype(float) * n
                cut_ = [x[a : a + SLICE].tobytes() for a in range(0, len(x), SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut_))), pa.array([n] * len(cut_)), pa.array(cut_, pa.binary())], ["k", "n", "x"])

        def mean(t: pa.Table) -> pa.Table:
            x = sum(np.frombuffer(b) for b in t.column("x").to_pylist()) / sum(t.column("n").to_pylist())
            return pa.table([t.column("k").slice(0, 1), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["k", "x"])

        mine = rows.filter(F.pmod(F.col("deal"), F.lit(rounds)) == r).select("n", "ids").coalesce(shares)
        got = mine.mapInArrow(run, "k long, n long, x binary").groupBy("k").applyInArrow(mean, "k long, x binary").toArrow()
        if got.num_rows:
            by = np.argsort(got.column("k").to_numpy())
            x = got.column("x").to_pylist()
            net = Network.of(np.concatenate([np.frombuffer(x[i], "<f4") for i in by]), shape)
    return net


def score_ids(net: Network, ids: list[bytes], kind: type = np.uint8) -> np.ndarray:
    """Sum of the log probabilities of each document's classes."""
    flat, at, first = layout(ids, kind)
    near, target = sides(flat, kind)
    logp = np.zeros(len(at) + 1)
    for lo in range(0, len(at), 4 * BATCH):
        here = at[lo : lo + 4 * BATCH]
        logp[lo : lo + len(here)] = net.of_targets(net.hidden(window_rows(near, here, net.shape.inputs)), target[here])[0]
    total = np.append(0, np.cumsum(logp))
    return total[first[1:]] - total[first[:-1]]


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, tokens, log_likelihood, mean_log_prob for each row of docs (doc_id, text)."""
    blocks = K.saved(cut(docs))
    words = block_words(blocks)
    counts = K.saved(total_counts(words))
    vocab = vocabulary(counts)
    rows = K.saved(tokens(blocks, words, counts, vocab))
    net = train(rows, vocab, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.round(score_ids(shared.value, unpacked(b), np.uint32) + b.column("within").to_numpy(), 4)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(total)], ["doc_id", "tokens", "log_likelihood"])

    out = rows.select("doc_id", "n", "ids", "within").mapInArrow(run, "doc_id long, tokens long, log_likelihood double")
    return out.withColumn("mean_log_prob", F.when(F.col("tokens") > 0, F.round(F.col("log_likelihood") / F.col("tokens"), 6)))
