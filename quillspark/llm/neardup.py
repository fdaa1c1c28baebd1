"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A text is the set of its runs of SHINGLE words.  Its sketch has T coordinates,
filled in rounds: in round i < T every element is thrown into one hashed bin
with the value i + u, u its hashed fraction; in round T + j every element goes
into bin j.  A bin keeps its least value, and the rounds end as soon as every
bin is filled, so a large set needs one or two rounds and no coordinate ever
stays empty.  Two sketches agree in a coordinate with probability J, with
Chernoff-like concentration over the coordinates.

Sketches are cut into bands.  Texts with the same shingle set are collapsed
first, so that a group of thousands of copies is one representative in every
bucket.  Within a bucket each representative is compared with the smallest
one; the exact Jaccard similarity of the shingle sets decides.  Members of a
bucket that are still in different components are then compared with each
other: in a bucket of at most PAIRED members pair by pair, in a larger one
where they share a shingle that is rare in the large buckets.  The rare
shingles of a set are the first of it, in the order of their frequency, that
any set similar enough must share one of, so no pair is lost; what many texts
have in common, a passage or boilerplate, comes last in that order and joins
none.  Groups are thus the connected components of all verified pairs that
share a bucket; no bucket is capped, and none is gathered in one place.

A row is known by two 64-bit hashes of its id and text, a shingle set by its
size and two; within the graph representatives have numbers.

Defined results
    null text: never a duplicate.  A text without words: compared by its
    characters, unless it is empty or blank, then never a duplicate.  Fewer
    words than a shingle has: all its words are its one shingle.  Very long texts: compared whole.
    ties: the smallest doc_id of a group stays, of equal ids the row whose hash is smaller.
    Repeated rows (same doc_id and text): one stays, whether they have words or not, if their text isn't null, empty or blank.
    Rows with the same doc_id and different texts are different documents; a null doc_id sorts last.
    ``duplicates`` has a row for each row that ``deduplicate`` drops.
    Extra columns, of any name: ignored by ``duplicates``, kept by ``deduplicate``.  Empty table: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

SHINGLE = 3
BANDS = 40
ROWS = 4
THRESHOLD = 0.5
PAIRED = 32
_U = np.uint64


def shingle_sets(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash), sorted, of the distinct shingles of each text."""
    w = K.Words(texts)
    at, h = w.grams(n)
    doc = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero(count < n)
    if len(short):
        extra_d, extra_h = [], []
        for d in short:
            if count[d]:
                extra_d.append(d)
                extra_h.append(K.gram_hash(w.hash, np.array([w.first[d]]), int(count[d]))[0])
            elif texts[d].strip():
                extra_d.append(d)
                extra_h.append(K.hash_words([texts[d].strip()])[0])
        doc = np.concatenate([doc, np.array(extra_d, doc.dtype)])
        h = np.concatenate([h, np.array(extra_h, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, t: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, t) sketch of each document's elements; documents without elements get all ones."""
    full = np.full(n_docs * t, ~_U(0))
    seeds = K.mix(np.arange(1, 2 * t + 1, dtype=np.uint64))
    d, e, i = doc * t, h, 0
    while len(e) and i < 2 * t:
        # later rounds can't change a filled bin, so a block of rounds may end late
        k = min(max(1, i), 2 * t - i, max(1, (1 << 20) // len(e)))
        x = (e ^ seeds[i : i + k, None]) * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(29)
        x *= _U(0x94D049BB133111EB)
        rounds = np.arange(i, i + k)[:, None]
        b = np.where(rounds < t, ((x >> _U(40)) * _U(t) >> _U(24)).astype(np.int64), rounds - t)
        # the round above 40 bits of fraction: an earlier round's value is always less
        np.minimum.at(full, (d + b).ravel(), ((rounds.astype(np.uint64) << _U(40)) | (x & _U((1 << 40) - 1))).ravel())
        i += k
        open_ = np.zeros(n_docs, bool)
        open_[np.flatnonzero(full == ~_U(0)) // t] = True
        live = open_[d // t]
        d, e = d[live], e[live]
    return full.reshape(n_docs, t)


def band_hashes(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = s.shape[1] // bands
    out = np.zeros((len(s), bands), np.uint64)
    for k in range(rows):
        out = K.mix(out * _U(31) + s[:, k::rows][:, :bands])
    return K.mix(out + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _set_hash(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set and its size."""
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for seed in (11, 12):
        c = np.append(_U(0), np.cumsum(K.mix(h ^ _U(seed))))
        out.append(c[first[1:]] - c[first[:-1]])
    return out[0], out[1], np.diff(first)


def _row_key() -> list[Column]:
    """Two hashes of a row's id and text."""
    return [F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull(), "text").alias(f"key{seed}") for seed in (1, 2)]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", *_row_key(), "text")


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key1, key2, a, b, n (the shingle set's hashes and size), bands of each document that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in K.text_chunks(batch.column("text").to_pylist()):
                doc, h = shingle_sets(part, shingle)
                a, b, n = _set_hash(doc, h, len(part))
                has = np.flatnonzero(n)
                s = band_hashes(sketch(doc, h, len(part), bands * rows)[has], bands).astype(np.int64)
                given = [batch.column(c).slice(lo, hi - lo).take(pa.array(has)) for c in ("doc_id", "key1", "key2")]
                made = [pa.array(a[has].astype(np.int64)), pa.array(b[has].astype(np.int64)), pa.array(n[has]), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(s.ravel()))]
                yield pa.RecordBatch.from_arrays(given + made, ["doc_id", "key1", "key2", "a", "b", "n", "bands"])

    return _source(docs).filter("text is not null").mapInArrow(run, "doc_id long, key1 long, key2 long, a long, b long, n long, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rep")
            for lo, hi, part in K.text_chunks(batch.column("text").to_pylist()):
                doc, h = shingle_sets(part, shingle)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())], ["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """u, v of the pairs whose exact Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = int((K.in_sorted(x, y) >= 0).sum())
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("s"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("t"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "s", "t").mapInArrow(run, "u long, v long")


def _sharing_rare(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """u, v: pairs of members (rep, root) of different roots that share one of each other's rare shingles.

    Of a set of n, those but the last ceil(threshold * n) - 1 in the order of frequency: sets that are similar enough have
    ceil(threshold * n) at least in common, so not all of those are among its last ones, and the first they share, in an
    order that is the same for both, is among the rare ones of both."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
            n = np.fromiter(map(len, got), np.int64, len(got))
            cols = [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("rep", "root")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(got) if got else np.zeros(0, np.int64)), pa.array(np.repeat(n, n))], ["rep", "root", "h", "n"])

    rows = members.join(sets, "rep").select("rep", "root", "shingles").mapInArrow(explode, "rep long, root long, h long, n long")
    counts = rows.groupBy("h").agg(F.count("*").alias("c"), (F.min("root") != F.max("root")).alias("mixed"))
    order = Window.partitionBy("rep").orderBy("c", "h")
    ranked = rows.join(counts, "h").withColumn("place", F.row_number().over(order))
    rare = ranked.filter(F.col("mixed") & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)).select("h", "rep", "root")
    left, right = rare.select("h", F.col("rep").alias("u"), F.col("root").alias("ru")), rare.select("h", F.col("rep").alias("v"), F.col("root").alias("rv"))
    return left.join(right, "h").filter("ru < rv").select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges u, v: alternating large and small stars."""
    e = K.saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = K.saved(small.filter("u > v").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _groups(docs: DataFrame, shingle: int, bands: int, rows: int, threshold: float, paired: int = PAIRED) -> tuple[DataFrame, DataFrame]:
    """The members (doc_id, key1, key2, root: the number of their group) of all groups of two rows or more; the sketch rows."""
    every = K.saved(sketches(docs, shingle, bands, rows))
    small = every.select("doc_id", "key1", "key2", "a", "b", "n")
    reps = every.groupBy("a", "b", "n").agg(F.min(F.struct("key1", "key2")).alias("k"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # numbered as they are stored, so that the numbers stay
    reps = K.saved(reps.select("a", "b", "n", "k.key1", "k.key2", "copies", "bands", F.monotonically_increasing_id().alias("rep")))
    placed = reps.select(F.explode("bands").alias("band"), "rep")
    least = placed.groupBy("band").agg(F.min("rep").alias("u"), F.count("*").alias("size")).filter("size > 1")
    buckets = K.saved(placed.join(least, "band").select("band", "size", "u", F.col("rep").alias("v")))
    star = K.saved(buckets.filter("u <> v").select("u", "v").distinct())
    nodes = buckets.select(F.col("v").alias("rep")).distinct().join(reps.select("rep", "key1", "key2"), "rep")
    # one row for each representative even where rows repeat
    sets = K.saved(_sets(_source(docs).join(nodes, ["key1", "key2"]).select("rep", "text"), shingle).groupBy("rep").agg(F.first("shingles").alias("shingles")))
    edges = K.saved(_verified(star, sets, threshold))
    comp = K.saved(components(edges))
    rooted = buckets.select("band", "size", F.col("v").alias("rep")).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("band", "size", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    open_ = K.saved(rooted.join(mixed, "band"))
    few = open_.filter(F.col("size") <= paired)
    rest = few.select("band", F.col("rep").alias("u"), F.col("root").alias("ru")).join(few.select("band", F.col("rep").alias("v"), F.col("root").alias("rv")), "band").filter("ru < rv").select("u", "v")
    rest = rest.unionByName(_sharing_rare(open_.filter(F.col("size") > paired).select("rep", "root").distinct(), sets, threshold)).distinct()
    rest = rest.join(star, (F.greatest(rest.u, rest.v) == star.v) & (F.least(rest.u, rest.v) == star.u), "left_anti")
    more = K.saved(_verified(rest, sets, threshold))
    if more.limit(1).count():
        comp = K.saved(components(edges.union(more)))
    named = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", "n", F.coalesce("root", "rep").alias("root"), "copies", F.col("root").isNotNull().alias("near"))
    named = named.filter("near or copies > 1")
    return small.join(named, ["a", "b", "n"]).select("doc_id", "key1", "key2", "root"), every


_ORDER = ["doc_id is null", "doc_id", "key1", "key2"]


def _dropped(docs: DataFrame, *how) -> DataFrame:
    """doc_id, key1, key2, kept_id, copies (rows of these keys), same (its own group's keeper): each different row of a group."""
    members, _ = _groups(docs, *how)
    rows = members.groupBy("doc_id", "key1", "key2", "root").agg(F.count("*").alias("copies"))
    keep = rows.groupBy("root").agg(F.min(F.struct(*map(F.expr, _ORDER))).alias("k")).select("root", F.col("k.doc_id").alias("kept_id"), F.col("k.key1").alias("k1"), F.col("k.key2").alias("k2"))
    return rows.join(keep, "root").select("doc_id", "key1", "key2", "kept_id", "copies", ((F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2"))).alias("same"))


def duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, duplicate_of: each row that goes, with the doc_id of the one of its group that stays."""
    gone = _dropped(docs, shingle, bands, rows, threshold).withColumn("times", F.col("copies") - F.col("same").cast("int")).filter("times > 0")
    return gone.select("doc_id", F.col("kept_id").alias("duplicate_of"), F.explode(F.sequence(F.lit(1), "times")).alias("_")).drop("_")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one document of each group of near-duplicates."""
    rows_ = K.saved(_dropped(docs, shingle, bands, rows, threshold).filter("not same or copies > 1").select("key1", "key2", "same"))
    packed = docs.select(F.struct("*").alias("row"), *[F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text").alias(f"key{seed}") for seed in (1, 2)])
    gone, again = rows_.filter("not same").drop("same"), rows_.filter("same").drop("same")
    left = packed.join(gone, ["key1", "key2"], "left_anti")
    if again.limit(1).count():  # rows that repeat: one of them
        left = left.join(again, ["key1", "key2"], "left_anti").unionByName(left.join(again, ["key1", "key2"], "left_semi").dropDuplicates(["key1", "key2"]))
    return left.select("row.*")
