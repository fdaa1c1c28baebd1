"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every document is searched, whole, for the word n-grams of the test items.  A
first pass counts in how many documents each of those n-grams occurs.  In the
second pass a hit weighs log(documents / occurrences): a rare n-gram opens an
alignment by itself, common ones only where several different ones of an item
lie on nearly the same diagonal (SEED_WEIGHT together, or SEED_SHARE of what
all of the item's would weigh); none is dropped.  The words around the
diagonal are aligned with the item by Smith-Waterman over words; the score is
divided by that of a full copy.  Substitutions, gaps and reorderings of words
lower the score instead of hiding the copy.

The test items travel to the workers as sorted hash arrays.  Their size is
checked: more than ``max_words`` item words are split into several sets, each
with its own pass over the documents, so that what is broadcast stays bounded.

Defined results
    null or empty document or item text: no row.  An item with fewer words
    than an n-gram has is sought by all its words; it must match as a whole.
    very long texts: searched whole; very long items: aligned whole, with fewer windows at a time.
    empty tables: no row; without items ``remove_leaks`` keeps all documents.
    ties: of several equal alignments the first in the document.
    repeated rows: equal (doc_id, text) rows give one result row; a repeated
    item gives one row for each item_id.  Rows with the same doc_id and
    different texts: the better alignment stands.  Null ids: kept as null.
    extra columns: ignored by ``leaks``, kept by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

NGRAM = 3
MIN_SCORE = 0.5
SEED_WEIGHT = 4.0  # natural log: an n-gram in fewer than one of 55 documents suffices
SEED_SHARE = 0.3  # of the summed weight of all n-grams of an item
MIN_WEIGHT = 0.2
MAX_WORDS = 200_000
CELLS = 1 << 20  # words of windows aligned together
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    sizes: np.ndarray
    grams: dict[int, np.ndarray]  # n: sorted distinct hashes
    first: dict[int, np.ndarray]  # n: where the places of a gram begin
    item: dict[int, np.ndarray]
    pos: dict[int, np.ndarray]

    def gram_count(self) -> int:
        return sum(map(len, self.grams.values()))


def index_items(ids: list, texts: list[str | None], n: int = NGRAM) -> Items:
    keep = [(i, t) for i, t in zip(ids, texts) if t]
    w = K.Words([t for _, t in keep])
    words = [w.words_of(d) for d in range(len(keep))]
    keep, words = [k for k, x in zip(keep, words) if len(x)], [x for x in words if len(x)]
    sizes = np.array([len(x) for x in words], np.int64)
    places: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, x in enumerate(words):
        m = min(n, len(x))
        places.setdefault(m, []).append((K.gram_hash(x, np.arange(len(x) - m + 1), m), k))
    out = Items([i for i, _ in keep], words, sizes, {}, {}, {}, {})
    for m, rows in places.items():
        h = np.concatenate([r for r, _ in rows])
        item = np.concatenate([np.full(len(r), k) for r, k in rows])
        pos = np.concatenate([np.arange(len(r)) for r, _ in rows])
        order = np.argsort(h, kind="stable")
        out.grams[m], out.first[m] = np.unique(h[order], return_index=True)
        out.first[m] = np.append(out.first[m], len(h))
        out.item[m], out.pos[m] = item[order], pos[order]
    return out


def find_grams(w: K.Words, items: Items, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word's index, index of the gram) of each place where one of the items' grams of n words begins."""
    at, h = w.grams(n)
    low = items.grams[n]
    # most n-grams are in no item: a small bitmap spares the search
    bits = np.zeros(1 << 16, bool)
    bits[low >> np.uint64(48)] = True
    maybe = np.flatnonzero(bits[h >> np.uint64(48)])
    i = K.in_sorted(h[maybe], low)
    found = i >= 0
    return at[maybe[found]], i[found]


def align(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score, with the window's words it spans (start, end), for rows of windows and items (0 pads both)."""
    m, width = doc.shape
    h = np.zeros((m, width + 1), np.int32)
    src = np.broadcast_to(np.arange(width + 1), (m, width + 1)).copy()
    best, begin, end = np.zeros(m, np.int32), np.zeros(m, np.int64), np.zeros(m, np.int64)
    slope = np.arange(width + 1) * -GAP
    rows = np.arange(m)
    col = np.arange(width + 1)
    for i in range(item.shape[1]):
        x = item[:, i : i + 1]
        live = x[:, 0] != 0
        s = np.where((doc == x) & (x != 0), MATCH, MISMATCH)
        diag = h[:, :-1] + s
        up = h[:, 1:] + GAP
        take = diag >= up
        t = np.where(take, diag, up)
        o = np.where(take, src[:, :-1], src[:, 1:])
        fresh = t <= 0
        t[fresh] = 0
        o = np.where(fresh, col[1:], o)
        t = np.concatenate([np.zeros((m, 1), np.int32), t], 1)
        o = np.concatenate([np.zeros((m, 1), np.int64), o], 1)
        # a gap along the window: the best earlier cell less its distance
        lifted = t + slope
        run = np.maximum.accumulate(lifted, 1)
        origin = np.maximum.accumulate(np.where(lifted == run, col, 0), 1)
        nh = (run - slope).astype(np.int32)
        no = np.take_along_axis(o, origin, 1)
        nh[nh < 0] = 0
        no = np.where(nh == 0, col, no)
        h[live], src[live] = nh[live], no[live]
        j = h.argmax(1)
        top = h[rows, j]
        better = live & (top > best)
        best[better], end[better], begin[better] = top[better], j[better], src[rows, j][better]
    return best, begin, end


def weights(counts: np.ndarray, n_docs: int) -> np.ndarray:
    return np.maximum(MIN_WEIGHT, np.log(max(n_docs, 1) / np.maximum(counts, 1)))


def search(texts: list[str], items: Items, weight: dict[int, np.ndarray], min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(text's index, item's index, score, first word, word after the last) of the best alignment of each text and item."""
    w = K.Words(texts)
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for n, grams in items.grams.items():
        at, g = find_grams(w, items, n)
        if not len(at):
            continue
        count = items.first[n][g + 1] - items.first[n][g]
        hit = np.repeat(np.arange(len(at)), count)
        place = np.repeat(items.first[n][g] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(len(hit))
        item, pos, word, gram = items.item[n][place], items.pos[n][place], at[hit], g[hit]
        doc = w.doc[word]
        size = items.sizes[item]
        slack = size // 4 + 2
        diagonal = word - pos - w.first[doc]
        band = np.floor_divide(diagonal, slack)
        # each hit counts in its band and in the one before, so that no copy is cut by a band's edge
        both = [np.concatenate([x, x]) for x in (doc, item, gram)] + [np.concatenate([band, band - 1])]
        order = np.lexsort((both[2], both[3], both[1], both[0]))
        d, it, gr, ba = (x[order] for x in both)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (ba[1:] != ba[:-1])
        distinct = new.copy()
        distinct[1:] |= gr[1:] != gr[:-1]
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.where(distinct, weight[n][gr], 0))
        # in a small corpus nothing is rare: a part of what the whole item would weigh suffices
        whole = np.bincount(items.item[n], np.repeat(weight[n], np.diff(items.first[n])), len(items.sizes))
        begins = np.flatnonzero(new)
        first = begins[total >= np.minimum(SEED_WEIGHT, SEED_SHARE * whole[it[begins]])]
        d, it, ba = d[first], it[first], ba[first]
        size = items.sizes[it]
        slack = size // 4 + 2
        start = np.maximum(0, ba * slack - slack)
        length = np.minimum(w.first[d + 1] - w.first[d] - start, size + 4 * slack)
        ok = length > 0
        d, it, start, length = d[ok], it[ok], start[ok], length[ok]
        order = np.argsort(length, kind="stable")
        a = 0
        while a < len(order):
            # windows in the order of their lengths: so many at a time that the table of them stays small
            b = a + 1
            while b < len(order) and b - a < 512 and (b - a + 1) * int(length[order[b]]) <= CELLS:
                b += 1
            o, a = order[a:b], b
            wide, tall = int(length[o].max()), int(items.sizes[it[o]].max())
            dw, iw = np.zeros((len(o), wide), np.uint64), np.zeros((len(o), tall), np.uint64)
            for r, k in enumerate(o):
                p = w.first[d[k]] + start[k]
                dw[r, : length[k]] = w.hash[p : p + length[k]]
                iw[r, : items.sizes[it[k]]] = items.words[it[k]]
            # no alignment scores more than the item's words that the window has at all
            common = np.array([np.isin(iw[r, : items.sizes[it[k]]], dw[r]).sum() for r, k in enumerate(o)])
            may = common >= min_score * items.sizes[it[o]] - 1e-9
            o, dw, iw = o[may], dw[may], iw[may]
            if not len(o):
                continue
            best, begin, end = align(dw, iw)
            for r, k in enumerate(o):
                score = round(float(best[r]) / float(MATCH * items.sizes[it[k]]), 6)
                need = 1.0 if n == items.sizes[it[k]] else min_score  # an item of one gram matches as a whole
                if score >= need:
                    key, row = (int(d[k]), int(it[k])), (score, int(start[k] + begin[r]), int(start[k] + end[r]))
                    if key not in out or (-row[0], row[1]) < (-out[key][0], out[key][1]):
                        out[key] = row
    return [(d, i, *v) for (d, i), v in sorted(out.items())]


def _parts(benchmark: DataFrame, max_words: int) -> Iterator[tuple[list, list[str]]]:
    """The items in sets of about max_words words."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r[1].split()) + 1
        if size and size + n > max_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += n
    if ids:
        yield ids, texts


def _counts(docs: DataFrame, shared, n_grams: int) -> np.ndarray:
    """In how many documents each gram occurs, summed up without a shuffle of more than the grams themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total = np.zeros(n_grams, np.int64)
        for batch in batches:
            for _, _, part in K.text_chunks(batch.column("text").to_pylist()):
                w = K.Words(part)
                base = 0
                for n in sorted(items.grams):
                    at, g = find_grams(w, items, n)
                    pairs = np.unique(w.doc[at] * np.int64(len(items.grams[n])) + g)
                    total += np.bincount(base + pairs % len(items.grams[n]), minlength=n_grams)
                    base += len(items.grams[n])
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "c"])

    got = docs.select("text").filter("text is not null").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n_grams, np.int64)
    out[got.column("gram").to_numpy()] = got.column("c").to_numpy()
    return out


def _prepared(docs: DataFrame, benchmark: DataFrame, ngram: int, max_words: int):
    sc = docs.sparkSession.sparkContext
    n_docs = docs.select("doc_id").count()
    for ids, texts in _parts(benchmark, max_words):
        items = index_items(ids, texts, ngram)
        if not items.gram_count():
            continue
        c = _counts(docs, sc.broadcast(items), items.gram_count())
        weight, base = {}, 0
        for n in sorted(items.grams):
            weight[n] = weights(c[base : base + len(items.grams[n])], n_docs)
            base += len(items.grams[n])
        yield sc.broadcast((items, weight))


SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, ngram: int = NGRAM, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word for each document (doc_id, text) that holds a copy of a test item (item_id, text)."""

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weight = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for lo, _, part in K.text_chunks(batch.column("text").to_pylist()):
                    found = search(part, items, weight, min_score)
                    if found:
                        d, i, s, a, b = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[lo + x] for x in d], pa.int64()), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(s), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "score", "first_word", "end_word"])

        return run

    source = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    out = None
    for shared in _prepared(docs, benchmark, ngram, max_words):
        part = source.mapInArrow(searcher(shared), SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.min(F.struct(-F.col("score"), "first_word", "end_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.col1")).alias("score"), "b.first_word", "b.end_word")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, ngram: int = NGRAM, max_words: int = MAX_WORDS) -> DataFrame:
    """docs, all columns, without the documents that hold a copy of a test item."""

    def cleaner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weight = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, part in K.text_chunks(batch.column("text").to_pylist()):
                    keep[[lo + f[0] for f in search(part, items, weight, min_score)]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = docs
    for shared in _prepared(docs, benchmark, ngram, max_words):
        out = out.mapInArrow(cleaner(shared), docs.schema)
    return out
