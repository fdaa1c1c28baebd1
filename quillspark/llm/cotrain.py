"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

The text view holds measures of the text itself: relative frequencies of pairs
of neighbouring character classes, and shares of repeated words and lines, word lengths and the
like.  The metadata view holds what is known without reading the text: source,
language, length, and for documents with a page its URL and markup.  Each view is
a logistic classifier.  Both begin with labelled documents; in each round the
documents without label of which one view is confident become pseudo-labels for the
other, weighing together at most as much as the labels.  At last each view is
calibrated, and the two calibrated log-odds are combined, on labelled
documents kept out of training.

Features are made once and stored (a few hundred bytes a document).  Each
Newton step is one pass over all of them that sums partial Hessians, so labels,
pseudo-labels and standardisation cover the whole tables.

A page belongs to the document whose id ends the path of its URL (PAGE_DOC).

Defined results
    null or empty text: features of an empty text; it is scored like any other document.
    no page: markup features 0 and a feature saying so; several pages: their mean.
    null source, language or length: hashed as '', 0.  Null doc_id: scored without page and label.
    no labels, or labels of one class only: every score is 0.5 and ``keep`` is true.
    repeated labels of a document: good if at least half of them are.  Null labels don't count.
    repeated rows: each is scored.  Extra columns: ignored.  Empty table: no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

PAGE_DOC = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/(?:[^?#]*/)?(\d+)(?:[./?#].*)?$"
ROUNDS = 3
CONFIDENT = 0.95
STEPS = 4
RIDGE = 5e-3
PULL = 0.02
KEEP = 0.5
N_CLASSES = 8
N_TEXT = N_CLASSES * N_CLASSES + 12
BUCKETS = (8, 4, 8)  # source, language, host
N_META = 12 + sum(BUCKETS)
FOLDS = 4  # of the labelled documents, fold 0 calibrates and combines
_made: dict[str, np.ndarray] = {}


# --- features ---------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Character class of each code point: lower, upper, other word, digit, space, line feed, clause mark, symbol."""
    t = _made.get("quality")
    if t is None:
        base = K.tables()
        code = np.arange(K.LIMIT + 1)
        t = np.full(K.LIMIT + 1, 7, np.uint8)
        t[base["word"]] = 2
        changed = base["low"] != code
        t[changed & base["word"]] = 1
        upper_of = np.zeros(K.LIMIT + 1, bool)
        upper_of[base["low"][changed]] = True
        t[base["word"] & upper_of & ~changed] = 0
        t[48:58] = 3
        t[[32, 9, 0xA0, 0x202F]] = 4
        t[[10, 13]] = 5
        t[[ord(c) for c in ".,;:?'’-"]] = 6
        t[0xDF] = 0  # lower case without a simple upper case
        _made["quality"] = t
    return t


def text_features(texts: list[str]) -> np.ndarray:
    """(texts, N_TEXT) measures of each text."""
    n = len(texts)
    w = K.Words(texts)
    c = w.codes
    cls = _classes()[c.clipped()].astype(np.int64)
    doc = np.repeat(np.arange(n), c.length + 1)[: len(cls)]
    out = np.zeros((n, N_TEXT))
    chars = np.maximum(c.length, 1)
    if len(cls):
        same = doc[1:] == doc[:-1]
        last = (c.first + c.length)[:-1] - 1
        same[last[last >= 0]] = False  # not with the line feed that parts two texts
        key = (doc[:-1] * N_CLASSES + cls[:-1]) * N_CLASSES + cls[1:]
        out[:, : N_CLASSES * N_CLASSES] = np.bincount(key[same], minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1) / chars[:, None]
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / some
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    types = np.bincount(d[new], minlength=n)
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], run)
    again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    at, g = w.grams(3)
    go = np.lexsort((g, w.doc[at]))
    gd, gh = w.doc[at][go], g[go]
    gnew = np.ones(len(gh), bool)
    gnew[1:] = (gh[1:] != gh[:-1]) | (gd[1:] != gd[:-1])
    grams = np.maximum(np.bincount(gd, minlength=n), 1)
    lines = np.bincount(doc, cls == 5, n) if len(cls) else np.zeros(n)
    lines = np.maximum(lines - (np.arange(n) < n - 1), 0) + 1
    extra = [
        np.log1p(c.length), np.log1p(words), mean, np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / some - mean**2, 0)),
        types / some, top / some, np.bincount(w.doc[1:][again], minlength=n) / some, 1 - np.bincount(gd[gnew], minlength=n) / grams,
        np.log1p(words / lines), c.length / (some * 8.0), np.bincount(w.doc, length > 15, n) / some, np.bincount(w.doc, length < 3, n) / some,
    ]
    out[:, N_CLASSES * N_CLASSES :] = np.stack(extra, 1)
    return out


def page_features(pages: DataFrame) -> DataFrame:
    """key, host, m: for each document with pages the mean of their measures, and the least of their hosts."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    count = lambda s: (F.length(html) - F.length(F.replace(html, F.lit(s)))) / len(s)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    size = F.length(html)
    measures = [
        F.log1p(size.cast("double")), F.log1p(count("<a ")), F.log1p(count("<p")), F.log1p(count("<script")), F.log1p(count("<div")),
        F.length(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)) / 100.0, url.startswith("https").cast("double"), url.contains("?").cast("double"),
        F.size(F.split(host, r"\.")).cast("double"), count("<") / F.greatest(size, F.lit(1)),
    ]
    rows = pages.select(F.regexp_extract(url, PAGE_DOC, 1).try_cast("long").alias("key"), host.alias("host"), *[m.cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    means = [F.avg(f"m{i}") for i in range(len(measures))]
    return rows.filter("key is not null").groupBy("key").agg(F.min("host").alias("host"), F.array(*means).alias("m"))


def features(docs: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, fold, y (1, 0 or null), x (float32 bytes, both views) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in K.text_chunks(b.column("text").to_pylist()):
                x = text_features(part).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "source", "lang", "n_chars")), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "source", "lang", "n_chars", "t"])

    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), "text")
    base = base.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, t binary")
    marks = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("double").alias("q")).dropna().groupBy("key").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    joined = base.join(page_features(pages), base.doc_id == F.col("key"), "left").drop("key").join(marks, base.doc_id == F.col("key"), "left").drop("key")
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(n)).cast("int")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(FOLDS)).cast("int")
    flat = joined.select(
        "doc_id", fold.alias("fold"), "y", "t", "m", F.log1p(F.coalesce(F.greatest("n_chars", F.lit(0)), F.lit(0)).cast("double")).alias("size"),
        *[bucket(F.col(c), n).alias(f"b{i}") for i, (c, n) in enumerate(zip(("source", "lang", "host"), BUCKETS))],
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            meta = np.zeros((n, N_META), np.float32)
            m = b.column("m")
            has = np.flatnonzero(np.asarray(m.is_valid()))
            if len(has):
                meta[has, 2:12] = np.array([m[i].as_py() for i in has.tolist()])
            meta[has, 0] = 1
            meta[:, 1] = b.column("size").to_numpy(zero_copy_only=False)
            at = 12
            for i, k in enumerate(BUCKETS):
                on = has if i == 2 else np.arange(n)
                meta[on, at + b.column(f"b{i}").to_numpy(zero_copy_only=False)[on]] = 1
                at += k
            x = [t + r.tobytes() for t, r in zip(b.column("t").to_pylist(), meta)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fold"), b.column("y"), pa.array(x, pa.binary())], ["doc_id", "fold", "y", "x"])

    return flat.mapInArrow(assemble, "doc_id long, fold int, y int, x binary")


# --- classifiers --------------------------------------------------------------------


@dataclass
class Views:
    """Standardisation of all features, and a weight vector (bias last) for each view."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    #: factors of the text view's and the metadata view's log-odds, bias; then factor and bias of each view by itself
    mix: np.ndarray
    text_cal: np.ndarray
    meta_cal: np.ndarray

    def parts(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Standardised features of each view, with a column of ones."""
        x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        one = np.ones((len(x), 1))
        return np.hstack([x[:, :N_TEXT], one]), np.hstack([x[:, N_TEXT:], one])

    def logits(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.parts(raw)
        return a @ self.text, b @ self.meta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _pass(rows: DataFrame, measure, size: int) -> np.ndarray:
    """Sum over all rows (y, fold, x) of measure(y, fold, x)'s vectors; y is -1 without label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                y = b.column("y").fill_null(-1).to_numpy(zero_copy_only=False)
                total += measure(y, b.column("fold").to_numpy(zero_copy_only=False), b.column("x").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

    got = rows.select("y", "fold", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def _normal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and upper half of the Hessian of the weighted logistic loss, flat."""
    p = sigmoid(x @ beta)
    g = x.T @ (weight * (p - y))
    h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x
    return np.concatenate([g, h[np.triu_indices(len(beta))]])


def _step(beta: np.ndarray, flat: np.ndarray, ridge: float, prior: np.ndarray | float = 0.0) -> np.ndarray:
    """A Newton step; the ridge draws all but the last weight to the prior."""
    d = len(beta)
    h = np.zeros((d, d))
    h[np.triu_indices(d)] = flat[d:]
    h = h + np.triu(h, 1).T
    penalty = ridge * np.append(np.ones(d - 1), 1e-6)
    step = np.linalg.solve(h + np.diag(penalty + 1e-9), flat[:d] + penalty * (beta - prior))
    return beta - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))


def _sizes(d: int) -> int:
    return d + d * (d + 1) // 2


def _teach(v: Views, y: np.ndarray, fold: np.ndarray, raw: list[bytes], limit: float) -> tuple:
    """Features of both views, and what each learns from: target, -1 for nothing, and whether it is a pseudo-label."""
    a, b = v.parts(raw)
    train = (y >= 0) & (fold != 0)
    targets = []
    for z in (b @ v.meta, a @ v.text):  # the other view's opinion
        p = sigmoid(z)
        t = np.where(train, y, -1)
        if limit < 1:
            t = np.where((y < 0) & (p >= limit), 1, np.where((y < 0) & (p <= 1 - limit), 0, t))
        targets.append(t)
    return a, b, targets[0], targets[1], y < 0


def fit(rows: DataFrame, rounds: int = ROUNDS, steps: int = STEPS, limit: float = CONFIDENT) -> Views | None:
    """Both views and their combination, trained over rows (y, fold, x); None without labels of both classes."""
    sc = rows.sparkSession.sparkContext
    width = N_TEXT + N_META

    def moments(y, fold, raw):
        x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float)
        train, held = (y >= 0) & (fold != 0), (y >= 0) & (fold == 0)
        return np.concatenate([[len(x), (train & (y == 1)).sum(), (train & (y == 0)).sum(), (held & (y == 1)).sum(), (held & (y == 0)).sum()], x.sum(0), (x * x).sum(0)])

    s = _pass(rows, moments, 5 + 2 * width)
    n, good, bad, held_good, held_bad = s[:5]
    if not good or not bad:
        return None
    mean = s[5 : 5 + width] / n
    scale = 1 / np.sqrt(np.maximum(s[5 + width :] / n - mean**2, 1e-8))
    v = Views(mean.astype(np.float32), scale.astype(np.float32), np.zeros(N_TEXT + 1), np.zeros(N_META + 1), np.array([1.0, 1, 0]), np.array([1.0, 0]), np.array([1.0, 0]))
    st = _sizes(N_TEXT + 1)
    # classes weigh the same, the labels' weights add up to 1
    label_weight = np.array([0.5 / bad, 0.5 / good])

    for r in range(rounds + 1):
        now = limit if r else 2.0  # the first round has labels only
        teacher = sc.broadcast(v)

        def count(y, fold, raw, teacher=teacher, now=now):
            _, _, ta, tb, free = _teach(teacher.value, y, fold, raw, now)
            return np.array([(free & (t == k)).sum() for t in (ta, tb) for k in (0, 1)], float)

        found = _pass(rows, count, 4) if r else np.zeros(4)
        # a class of pseudo-labels weighs as much as that of the labels, no one of them more than a label
        pseudo = [np.minimum(0.5 / np.maximum(found[2 * k : 2 * k + 2], 1), label_weight) for k in (0, 1)]
        for _ in range(steps):
            student = sc.broadcast(v)

            def newton(y, fold, raw, teacher=teacher, student=student, now=now, pseudo=pseudo):
                a, b, ta, tb, free = _teach(teacher.value, y, fold, raw, now)
                out = []
                for x, t, beta, extra in ((a, ta, student.value.text, pseudo[0]), (b, tb, student.value.meta, pseudo[1])):
                    use = np.flatnonzero(t >= 0)
                    weight = np.where(free[use], extra[t[use]], label_weight[t[use]])
                    out.append(_normal(x[use], t[use], weight, beta))
                return np.concatenate(out)

            got = _pass(rows, newton, st + _sizes(N_META + 1))
            v = Views(v.mean, v.scale, _step(v.text, got[:st], RIDGE), _step(v.meta, got[st:], RIDGE), v.mix, v.text_cal, v.meta_cal)

    if held_good and held_bad:
        fixed = sc.broadcast(v)
        held_weight = np.array([0.5 / held_bad, 0.5 / held_good])
        # bias last; few held-out documents leave the views' log-odds, and their plain sum, nearly as they are
        betas = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]

        def calibrate(y, fold, raw, betas):
            held = np.flatnonzero((y >= 0) & (fold == 0))
            za, zb = (z[held] for z in fixed.value.logits(raw))
            one = np.ones(len(held))
            return np.concatenate([_normal(np.stack([z, one], 1), y[held], held_weight[y[held]], beta) for z, beta in zip((za, zb), betas)])

        for _ in range(steps + 2):
            got = _pass(rows, lambda y, f, x, betas=betas: calibrate(y, f, x, betas), 2 * _sizes(2))
            betas = [_step(b, g, PULL, np.array([1.0, 0.0])) for b, g in zip(betas, np.split(got, 2))]
        mix = np.array([1.0, 1.0, 0.0])

        def combine(y, fold, raw, mix):
            held = np.flatnonzero((y >= 0) & (fold == 0))
            za, zb = (z[held] for z in fixed.value.logits(raw))
            x = np.stack([betas[0][0] * za + betas[0][1], betas[1][0] * zb + betas[1][1], np.ones(len(held))], 1)
            return _normal(x, y[held], held_weight[y[held]], mix)

        for _ in range(steps):
            mix = _step(mix, _pass(rows, lambda y, f, x, mix=mix: combine(y, f, x, mix), _sizes(3)), PULL, np.array([1.0, 1.0, 0.0]))
            mix[:2] = np.maximum(mix[:2], 0)
        v = Views(v.mean, v.scale, v.text, v.meta, mix, betas[0], betas[1])
    return v


def judge(v: Views | None, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probability of good quality by text, by metadata, combined."""
    if v is None or not raw:
        half = np.full(len(raw), 0.5)
        return half, half, half
    za, zb = v.logits(raw)
    za, zb = v.text_cal[0] * za + v.text_cal[1], v.meta_cal[0] * zb + v.meta_cal[1]
    return sigmoid(za), sigmoid(zb), sigmoid(v.mix[0] * za + v.mix[1] * zb + v.mix[2])


def score(docs: DataFrame, pages: DataFrame, labels: DataFrame, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """doc_id, text_prob, meta_prob, quality_prob, keep for each row of docs (doc_id, text, lang, source, n_chars)."""
    rows = K.saved(features(docs, pages, labels))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m, p = (np.round(q, 6) for q in judge(shared.value, b.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a), pa.array(m), pa.array(p), pa.array(p >= keep)], ["doc_id", "text_prob", "meta_prob", "quality_prob", "keep"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, text_prob double, meta_prob double, quality_prob double, keep boolean")
