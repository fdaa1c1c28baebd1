"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into passages (at line ends, and at sentence ends that no
quotation mark follows).  A passage is a string over word classes (insult,
mild insult, threat, target, negation, reporting word, other) and marks
(comma or bracket, colon, quotation mark, sentence end within).  Six
sequential transducers rewrite it:

    attribution  read from right to left: what stands in quotation marks before a
                 reporting word ("...", he said) counts as quoted
    negation     a negation at most two words before an insult or threat voids it
    reported     after a reporting word, across commas, colons and an opening quotation mark, insults
                 and threats count as quoted, until a quotation mark closes or the passage ends
    target       marks insults and threats up to three words after a target as aimed, and
                 tells the next two transducers of a target up to two words after one
    insult       weighs an aimed insult, one without target, a target after one
    threat       weighs an aimed threat; a threat without target is nothing

The last five read from left to right and are composed into one deterministic
transducer before any text is read.  Only passages that hold an insult or
threat are run, all passages of a chunk side by side.  A document's score is
the sum over its passages, and it is toxic from ``threshold`` on.

Insults and threats are a fixed multilingual list; words that are insults in
few places only (clown, jerk) are mild and weigh little unless aimed, or marked by the labels.  Insult
stems are learned from labelled documents: prefixes of words that are so
frequent in toxic documents and so rare in others that chance is ruled out at
the level ``alpha``, corrected for the number of prefixes looked at.  Learning
reads at most ``max_labelled`` labelled documents, a documented bound, on the
executors; the driver gets counts by prefix.

Defined results
    null or empty text: score 0, no clause, not toxic.  Very long texts: scored whole.
    labels null or empty: the fixed list alone.  Repeated labels of a document: the largest counts.  Null labels don't count.
    repeated rows: each is scored by itself.  Extra columns: ignored by ``score``, kept by ``filter_clean``.
    empty table: no row.  Ties can't occur: a score is a sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

INSULTS = """idiot idiots moron morons scum imbecile dumbass vermin dummkopf trottel abschaum vollidiot imbécile crétin connard
estúpido estúpida imbécil""".split()
THREATS = """kill murder strangle destroy hurt stab töten umbringen erwürgen tuer étrangler poignarder matar
estrangular apuñalar""".split()
TARGETS = "you your yours yourself u ya dich dir dein deine euch vous votre toi ton usted ustedes tú tu tus".split()
NEGATIONS = "not never no isn aren wasn don doesn nicht nie niemals kein keine ne pas jamais nunca jamás".split()
REPORTS = """said says say told called calls wrote quoted claimed shouted sagte sagt nannte schrieb behauptete dit disait
appelle appelait écrit dijo dice llamó escribió""".split()
MILD = """clown clowns jerk stupid pathetic trash filth loser losers disgusting moronic idiotic basura ordure worthless""".split()
#: classes, by number, and their symbols; c, k, q, s: comma or bracket, colon, quotation mark, sentence end
SYMBOLS = "OIMVTNRckqs"
O, I, M, V, T, N, R, COMMA, COLON, QUOTE, STOP = range(len(SYMBOLS))
MARKS = "ckqs"
WEIGHTS = {"I": 0.6, "J": 1.2, "i": 0.2, "W": 1.5, "b": 0.6, "e": 1.0, "y": 0.1}
THRESHOLD = 1.0
MAX_LABELLED = 6000
STEM = (3, 10)


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: arcs[state][symbol] = (next state, output symbols); state 0 begins a clause."""

    arcs: tuple[dict[str, tuple[int, str]], ...]

    def compose(self, other: "Transducer") -> "Transducer":
        """The transducer that gives other's output on this one's output."""
        index, queue, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:  # grows
            row = {}
            for symbol, (na, out) in self.arcs[a].items():
                nb, final = b, ""
                for s in out:
                    nb, o = other.arcs[nb][s]
                    final += o
                if (na, nb) not in index:
                    index[na, nb] = len(queue)
                    queue.append((na, nb))
                row[symbol] = (index[na, nb], final)
            arcs.append(row)
        return Transducer(tuple(arcs))

    def run(self, symbols: str) -> str:
        state, out = 0, ""
        for s in symbols:
            state, o = self.arcs[state][s]
            out += o
        return out


def attribution(reach: int = 3) -> Transducer:
    """Read from right to left.  States: plain; 1 to reach, so many words more until a quotation mark must come; the last, within the quotation."""
    inside = reach + 1
    rows = []
    for s in range(reach + 2):
        if s == inside:
            row = {x: (inside, x) for x in "OTNRcks"} | {x: (inside, x.lower()) for x in "IMV"} | {"q": (0, "q")}
        else:
            step = max(0, s - 1)
            row = {x: (step, x) for x in "OIMVTN"} | {x: (s, x) for x in "cs"} | {"k": (0, "k"), "R": (reach, "R"), "q": (inside if s else 0, "q")}
        rows.append(row)
    return Transducer(tuple(rows))


def negation(reach: int = 2) -> Transducer:
    """x: voided; marks end a negation's reach; i, m, v are quoted already."""
    rows = []
    for s in range(reach + 1):
        step = max(0, s - 1)
        rows.append({x: ((0, "x") if s else (0, x)) for x in "IMV"} | {x: (0, "x" if s else "y") for x in "imv"} | {x: (step, x) for x in "OTR"} | {x: (0, x) for x in MARKS} | {"N": (reach, "O")})
    return Transducer(tuple(rows))


def reported() -> Transducer:
    """States: plain, after a reporting word, in the quotation after one."""
    other = "OTxy"
    plain = {x: (0, x) for x in other + "IMV" + MARKS} | {"R": (1, "O")}
    after = {x: (1, x) for x in other + "cks"} | {x: (1, "y") for x in "IMV"} | {"R": (1, "O"), "q": (2, "q")}
    quoted = {x: (2, x) for x in other + "cks"} | {x: (2, "y") for x in "IMV"} | {"R": (2, "O"), "q": (0, "q")}
    return Transducer((plain, after, quoted))


def target(before: int = 3, after: int = 2) -> Transducer:
    """States: (words since the last target that still reach, words that a target may yet come after a hit).  a: the next hit is aimed; p: a target after a hit."""
    index = {(t, h): t * (after + 1) + h for t in range(before + 1) for h in range(after + 1)}
    rows: list[dict] = [{} for _ in index]
    for (t, h), i in index.items():
        fade = index[max(0, t - 1), max(0, h - 1)]
        rows[i] |= {x: (fade, x) for x in "Oxy"} | {x: (0, "O") for x in MARKS}
        rows[i]["T"] = (index[before, 0], "p" if h else "O")
        for x in "IMV":
            rows[i][x] = (index[max(0, t - 1), 0], "a" + x) if t else (index[0, after], x)
    return Transducer(tuple(rows))


def insult() -> Transducer:
    """States: plain, aimed, after an insult, after a mild one.  J: aimed, b and e: a target after one."""
    def row(aimed: bool, late: str) -> dict:
        out = {x: ((2 if late == "b" else 3 if late == "e" else 0), x) for x in "Oxy"}
        out |= {"a": (1, ""), "p": (0, late or "p"), "I": (0, "J") if aimed else (2, "I"), "M": (0, "J") if aimed else (3, "i"), "V": (0, "aV" if aimed else "V")}
        return out

    return Transducer((row(False, ""), row(True, ""), row(False, "b"), row(False, "e")))


def threat() -> Transducer:
    """States: plain, aimed, after a threat."""
    rest = "OxyIJibe"
    row = lambda s: {x: (2 if s == 2 and x in "Oxy" else 0, x) for x in rest} | {"a": (1, ""), "V": (0, "W") if s == 1 else (2, "O"), "p": (0, "W" if s == 2 else "O")}
    return Transducer((row(0), row(1), row(2)))


def grammar() -> Transducer:
    """What is read from left to right, composed."""
    return negation().compose(reported()).compose(target()).compose(insult()).compose(threat())


QUOTED = {"i": "I", "m": "M", "v": "V"}


@dataclass(frozen=True)
class Machine:
    """Both directions as arrays over the classes and, for the second, the quoted ones: next states, and output class or weight."""

    back: np.ndarray
    back_out: np.ndarray
    step: np.ndarray
    weight: np.ndarray


def tables() -> Machine:
    classes = SYMBOLS + "imv"
    at = {x: k for k, x in enumerate(classes)}
    back, step = attribution(), grammar()
    b, bo = np.zeros((len(back.arcs), len(SYMBOLS)), np.int16), np.zeros((len(back.arcs), len(SYMBOLS)), np.int8)
    for s, row in enumerate(back.arcs):
        for c, x in enumerate(SYMBOLS):
            b[s, c], bo[s, c] = row[x][0], at[row[x][1]]
    f, w = np.zeros((len(step.arcs), len(classes)), np.int16), np.zeros((len(step.arcs), len(classes)))
    for s, row in enumerate(step.arcs):
        for c, x in enumerate(classes):
            f[s, c], out = row[x]
            w[s, c] = sum(WEIGHTS.get(o, 0) for o in out)
    return Machine(b, bo, f, w)


@dataclass
class Lexicon:
    words: np.ndarray  # sorted hashes
    classes: np.ndarray
    stems: dict[int, np.ndarray]  # length: sorted hashes

    def classify(self, w: K.Words) -> np.ndarray:
        out = np.zeros(len(w.hash), np.int8)
        for n, keys in self.stems.items():
            at = np.flatnonzero(w.end - w.start >= n)
            h = w.span_hash(w.start[at], w.start[at] + n)
            out[at[K.in_sorted(h, keys) >= 0]] = I
        i = K.in_sorted(w.hash, self.words)
        if not len(self.words):
            return out
        # a mild word that the labels mark is as strong as any
        return np.where((i >= 0) & ~((out == I) & (self.classes[i] == M)), self.classes[i], out)


def lexicon() -> Lexicon:
    entries: dict[str, int] = {}
    for c, words in ((I, INSULTS), (M, MILD), (V, THREATS), (T, TARGETS), (N, NEGATIONS), (R, REPORTS)):
        entries |= dict.fromkeys(words, c)
    h = K.hash_words(list(entries))
    order = np.argsort(h)
    return Lexicon(h[order], np.array(list(entries.values()), np.int8)[order], {})


# --- stems ------------------------------------------------------------------------------------------


def _prefixes(w: K.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, words' indices, hash of the words' first characters, hash of one character less) for each length of a stem."""
    for n in range(STEM[0], STEM[1] + 1):
        at = np.flatnonzero(w.end - w.start >= n)
        yield n, at, w.span_hash(w.start[at], w.start[at] + n), w.span_hash(w.start[at], w.start[at] + n - 1)


def _toxic_prefixes(rows: DataFrame) -> DataFrame:
    """n, h, up (hash of the prefix without its last character), docs, around: in how many toxic documents and different neighbourhoods a prefix is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in K.text_chunks(batch.column("text").to_pylist()):
                w = K.Words(part)
                doc = np.asarray(batch.column("row").slice(a, b - a))[w.doc]
                h = np.concatenate([[np.uint64(1)], w.hash, [np.uint64(1)]])
                edge = np.concatenate([[-1], w.doc, [-1]])
                left, right = np.where(edge[:-2] == w.doc, h[:-2], np.uint64(1)), np.where(edge[2:] == w.doc, h[2:], np.uint64(1))
                around = K.mix(K.mix(left * np.uint64(31) + w.hash) * np.uint64(31) + right).astype(np.int64)
                for n, at, x, up in _prefixes(w):
                    rows_ = np.unique(np.stack([x.astype(np.int64), up.astype(np.int64), doc[at], around[at]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows_.shape[1], n, np.int32)), *(pa.array(r) for r in rows_)], ["n", "h", "up", "doc", "around"])

    found = rows.mapInArrow(run, "n int, h long, up long, doc long, around long")
    by = ["n", "h", "up"]
    docs = found.select(*by, "doc").distinct().groupBy(*by).agg(F.count("*").alias("docs"))
    around = found.select(*by, "around").distinct().groupBy(*by).agg(F.count("*").alias("around"))
    return docs.filter("docs > 1").join(around, by)


def _clean_counts(rows: DataFrame, keys: np.ndarray) -> np.ndarray:
    """In how many of the documents each of the sorted prefix hashes is seen."""
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, _, part in K.text_chunks(batch.column("text").to_pylist()):
                w = K.Words(part)
                for _, at, x, _ in _prefixes(w):
                    i = K.in_sorted(x, shared.value)
                    pairs = np.unique(w.doc[at[i >= 0]] * np.int64(len(shared.value)) + i[i >= 0])
                    total += np.bincount(pairs % max(1, len(shared.value)), minlength=len(shared.value))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["i", "c"])

    got = rows.select("text").mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(len(keys), np.int64)
    out[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return out


def choose_stems(n: np.ndarray, h: np.ndarray, up: np.ndarray, seen: np.ndarray, clean: np.ndarray, toxic: int, others: int, alpha: float = 0.01) -> dict[int, np.ndarray]:
    """Prefix hashes, by length, that mark toxic documents; none that extends another.

    seen: a prefix's evidence, the smaller of the number of toxic documents and the number of different
    neighbourhoods (word before, word, word after) it is seen in there, so that copies and shared passages count once;
    clean: the number of other documents."""
    if not toxic or not others or not len(h):
        return {}
    base = toxic / (toxic + others)
    c = np.minimum(clean, seen)
    share = (seen - c) / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = seen * (share * np.log(share / base) + np.where(c > 0, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    ok = (seen >= 2) & (clean <= 0.02 * seen) & (divergence > math.log(max(len(h), 1) / alpha))
    good = {int(x): int(e) for x, e in zip(h[ok], seen[ok])}
    longer: dict[int, list[int]] = {}
    for x, u in zip(h[ok].tolist(), up[ok].tolist()):
        longer.setdefault(u, []).append(x)
    size = dict(zip(h[ok].tolist(), n[ok].tolist()))
    found: dict[int, set[int]] = {}
    for x, u in sorted(zip(h[ok].tolist(), up[ok].tolist())):
        if size[x] > STEM[0] and u in good:
            continue  # a shorter one stands for it
        while True:  # as long as one continuation keeps nearly all the evidence, it is part of the stem
            more = [y for y in longer.get(x, ()) if good[y] >= 0.9 * good[x]]
            if not more:
                break
            x = max(more, key=lambda y: (good[y], y))
        found.setdefault(size[x], set()).add(x)
    return {k: np.sort(np.array(list(v), np.int64).astype(np.uint64)) for k, v in found.items()}


def fit(docs: DataFrame, labels: DataFrame | None, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """The lexicon, its stems learned from at most max_labelled of the labelled documents."""
    lex = lexicon()
    if labels is None:
        return lex
    by = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > max_labelled:  # half as many again by the hash, then exactly so many in its order
        marks = marks.filter(by < int(min(1, 1.5 * max_labelled / n) * (1 << 30))).orderBy(by, "doc_id").limit(max_labelled)
    text = docs.select(F.col("doc_id").cast("long"), "text").filter("text <> ''")
    rows = text.join(F.broadcast(marks), "doc_id").select("text", (F.col("toxic") > 0).alias("bad"), F.monotonically_increasing_id().alias("row"))
    rows = K.saved(rows)  # the labelled texts, read once
    sizes = {r[0]: r[1] for r in rows.groupBy("bad").count().collect()}
    got = _toxic_prefixes(rows.filter("bad").select("text", "row")).toArrow()
    col = lambda c: got.column(c).to_numpy()
    h = col("h").astype(np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    clean = _clean_counts(rows.filter("not bad"), h) if len(h) else np.zeros(0, np.int64)
    seen = np.minimum(col("docs"), col("around"))[order]
    lex.stems = choose_stems(col("n")[order], h.astype(np.int64), col("up")[order], seen, clean, sizes.get(True, 0), sizes.get(False, 0))
    return lex


# --- scores ------------------------------------------------------------------------------------------

QUOTES = "«»“”„‟\"‹›"
_KINDS = {COMMA: ",()[]–—…", COLON: ":", QUOTE: QUOTES, STOP: ".;!?"}
_mark: list[np.ndarray] = []


def mark_table() -> np.ndarray:
    """The class of each code point that is a mark, -1 for a line end, else 0."""
    if not _mark:
        t = np.zeros(K.LIMIT + 1, np.int8)
        for k, chars in _KINDS.items():
            t[[ord(c) for c in chars]] = k
        t[[10, 13]] = -1
        _mark.append(t)
    return _mark[0]


def score_texts(texts: list[str], lex: Lexicon, m: Machine) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of scoring passages of each text."""
    w = K.Words(texts)
    cls = lex.classify(w)
    score, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    hot = np.flatnonzero((cls == I) | (cls == M) | (cls == V))
    if not len(hot):
        return score, count
    kind = mark_table()[w.codes.clipped()]
    ends = kind == -1
    # a sentence end before a quotation mark, or before the space before none, is within the passage
    ends[:-1] |= (kind[:-1] == STOP) & (kind[1:] != QUOTE) & (kind[1:] != STOP)
    ends[-1:] |= kind[-1:] == STOP
    passage = np.cumsum(ends)
    of = passage[w.start]
    wanted = np.zeros(int(passage[-1]) + 1, bool)
    wanted[of[hot]] = True
    at = np.flatnonzero(wanted[of])
    marks = np.flatnonzero(kind > 0)
    marks = marks[wanted[passage[marks] - ends[marks]]]
    place = np.concatenate([w.start[at], marks])
    order = np.argsort(place, kind="stable")
    symbol = np.concatenate([cls[at], kind[marks]])[order]
    group = np.concatenate([of[at], passage[marks] - ends[marks]])[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    last = np.append(first[1:], len(group))
    if (symbol == R).any():  # from right to left, passages with a reporting word after a quotation
        has = np.flatnonzero(np.bitwise_or.reduceat(np.where(symbol == R, 1, 0) | np.where(symbol == QUOTE, 2, 0), first) == 3)
        pos, state = last[has] - 1, np.zeros(len(has), np.int64)
        live = np.arange(len(has))
        while len(live):
            c = symbol[pos[live]]
            symbol[pos[live]] = m.back_out[state[live], c]
            state[live] = m.back[state[live], c]
            pos[live] -= 1
            live = live[pos[live] >= first[has[live]]]
    pos, state, total = first.copy(), np.zeros(len(first), np.int64), np.zeros(len(first))
    live = np.arange(len(first))
    while len(live):
        c = symbol[pos[live]]
        total[live] += m.weight[state[live], c]
        state[live] = m.step[state[live], c]
        pos[live] += 1
        live = live[pos[live] < last[live]]
    doc = np.searchsorted(w.codes.first, place[order][first], "right") - 1
    np.add.at(score, doc, total)
    np.add.at(count, doc, total > 0)
    return np.round(score, 6), count


def _judge(batch: pa.RecordBatch, lex: Lexicon, m: Machine) -> tuple[np.ndarray, np.ndarray]:
    got = [score_texts(part, lex, m) for _, _, part in K.text_chunks(batch.column("text").to_pylist())]
    return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0), np.zeros(0, np.int64))


def score(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score, clauses, toxic for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((fit(docs, labels, max_labelled), tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = _judge(b, *shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(n), pa.array(s >= threshold)], ["doc_id", "score", "clauses", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, clauses long, toxic boolean")


def filter_clean(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, all columns, that aren't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((fit(docs, labels, max_labelled), tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judge(b, *shared.value)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
