"""Twelve detectors of likely scanning damage, their counts as native expressions and their records with context.

Counts of a text are native expressions too, but a book's counts and all
records come from an Arrow pass that searches for the rarest part of each
pattern and tries the pattern only there; both agree (tests compare them).
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

LETTERS = "A-ZÀ-ÖØ-ÞŒÆa-zà-öø-ÿœæ"
WORD = f"[{LETTERS}]+(?:[-'’][{LETTERS}]+)*"
SMALL = T.LOWER + "œæ"
ELIDED = "^(?:jusqu|lorsqu|puisqu|quoiqu|qu|[cdjlmnst])'"
SHORTENED = r"\b(?:J\.-C|MM?|Mlles?|Mmes?|Dr|Pr|Ste?|art|av|cf|chap|etc|ex|n[o°]|p|vol)\.$"
STARTERS = "Alors Car Ce Ces Cette Des Donc Elle Elles Et Il Ils Je La Le Les Mais Ni Nous On Or Ou Puis Tu Un Une Vous".split()
DETERMINERS = "ce ces cette des du la le les leur ma mes mon notre sa ses son un une votre".split()
DOUBLED = "ah hé ho non nous oh oui si tout très vous".split()
L = f"[{T.LOWER}]"

#: type: pattern; the order is that of the detectors within a document
PATTERNS = {
    "min_apres_point": rf"(?<![.…])\. ({L})",
    "maj_apres_virgule": rf", ({'|'.join(sorted(STARTERS, key=len, reverse=True))})\b",
    "point_colle": rf"{L}{{2}}\.{L}{{2}}",
    "det_virgule": rf"\b({'|'.join(DETERMINERS)}) ?, {L}",
    "abrev_m": rf"\bM ([A-ZÀ-Ö]{L}+)",
    "mot_double": rf"\b({L}{{2,}}) \1\b",
    "quatre_points": r"\.{4,}",
    "espace_avant_point": rf"{L} [,.](?=[ \n])",
    "virgule_point": r"[,.][,.]",
    "cesure_residuelle": rf"\b({L}{{2,}})- ({L}{{2,}})\b",
}
TYPES = ["mot_inconnu", *PATTERNS, "guillemet_desequilibre"]
DOMAIN = r"\.(?:com|fr|net|org)\b"
CONTEXT = 60
PER_TYPE = 400


# --- words --------------------------------------------------------------------------------------


def norm_word(w: T.Text) -> Column:
    """Composed, lower case, straight apostrophe, without an elided word before it."""
    w = F.replace(F.lower(T.nfc(T.col(w))), F.lit("’"), F.lit("'"))
    return T.sub(w, ELIDED, "")


FLUSH_BOOKS = 50_000  # books whose sums a task holds before it passes them on
FLUSH = 500_000  # distinct forms that a task holds before it passes them on
PASSED = 20_000  # of them made into rows at a time


def book_words(docs: DataFrame, book: list[str], text: str = "text", first: str | None = None) -> DataFrame:
    """word, n, seen_lower for each book: frequency, and whether it was seen with a small initial; with first, a column of docs, also its least value, null before all.

    Each task counts equal forms of a book before anything is shuffled; only distinct forms are normalised."""
    kinds = dict(docs.dtypes)
    names = [*book, "word", "n", "small"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in book), "word string, n long, small boolean"])
    if first:
        names, schema = [*names, "some", "first"], schema + f", some boolean, first {kinds[first]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        firsts: dict[tuple, dict[str, tuple]] = {}
        kind: list[pa.DataType] = []
        cut = re.compile(WORD).findall

        def flush() -> Iterator[pa.RecordBatch]:
            types = [*kind[:-1], pa.string(), pa.int64(), pa.bool_(), *([pa.bool_(), kind[-1]] if first else [])]
            rows = ((*k, _norm(f), n, f[:1] != f[:1].upper(), *(firsts[k][f] if first else ())) for k, c in counts.items() for f, n in c.items())
            while part := list(itertools.islice(rows, PASSED)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), types)], names)
            counts.clear()
            firsts.clear()

        for b in batches:
            kind = [b.column(i).type for i in range(len(book) + 1)]
            held = sum(map(len, counts.values()))
            for *k, d, t in T.rows(b):
                if t:
                    of, found = tuple(k), cut(t)
                    count = counts.setdefault(of, Counter())
                    held -= len(count)
                    count.update(found)
                    held += len(count)
                    if first:
                        at, seen = (d is not None, d), firsts.setdefault(of, {})
                        for f in set(found):
                            if f not in seen or at < seen[f]:
                                seen[f] = at
                    if held > FLUSH:
                        yield from flush()
                        held = 0
        if counts:
            yield from flush()

    forms = docs.select(*book, (F.col(first) if first else F.lit(None).cast("int")).alias("__d"), F.col(text).alias("__t")).mapInArrow(run, schema)
    least = [F.min(F.struct("some", "first")).alias("first")] if first else []
    return forms.groupBy(*book, "word").agg(F.sum("n").alias("n"), F.bool_or("small").alias("seen_lower"), *least)


def unknown_words(docs: DataFrame, book: list[str], lexicon: DataFrame | None = None, dictionary: DataFrame | None = None, text: str = "text", first: str | None = None) -> DataFrame:
    """Rare lower-case words of each book that are neither in the lexicon nor in the dictionary (both: word); first: see book_words."""
    w = book_words(docs, book, text, first).filter((F.col("n") < 3) & F.col("seen_lower") & (F.length("word") >= 3) & F.col("word").rlike(f"^[{SMALL}][{SMALL}'’-]*$"))
    for known in (lexicon, dictionary):
        if known is not None:
            w = w.join(known.select("word").distinct(), "word", "left_anti")
    return w.select(*book, "word", "n", *(["first"] if first else []))


# --- counts ----------------------------------------------------------------------------------------


def counts(text: T.Text) -> dict[str, Column]:
    """Matches of each detector that needs no word list, in one text: regular expressions in the JVM.

    Exceptions are told by a look-behind, or by what was matched."""
    t = T.col(text)
    found = {k: T.count_re(t, "(?U)" + p) for k, p in PATTERNS.items()}
    hits = lambda pattern, group, keep: F.size(F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), keep)).cast("long")
    found["min_apres_point"] = T.count_re(t, r"(?U)(?<![.…])(?<!" + SHORTENED.removesuffix(r"\.$") + rf")\. {L}")
    glued = PATTERNS["point_colle"]
    found["point_colle"] = hits(f"(?s)(?=({glued}.{{0,7}})){glued}", 1, lambda w: ~w.rlike(rf"(?U){DOMAIN}"))
    found["mot_double"] = hits("(?U)" + PATTERNS["mot_double"], 1, lambda w: ~w.isin(*DOUBLED))
    found["virgule_point"] = hits(PATTERNS["virgule_point"], 0, lambda w: w != "..")
    found["guillemet_desequilibre"] = (T.count_of(t, "«") != T.count_of(t, "»")).cast("long")
    return found


def count_by_book(docs: DataFrame, book: list[str], text: str = "text", types: list[str] | None = None) -> DataFrame:
    """type, n for each book, the types that need no word list, or some of them; each task adds up its books, only sums are shuffled."""
    types = types or [*PATTERNS, "guillemet_desequilibre"]
    kinds, names = dict(docs.dtypes), [*book, *types]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in book), *(f"{k} long" for k in types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int] | None] = {}
        kind: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            rows = [(*k, *(n or [None] * len(types))) for k, n in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [*kind, *[pa.int64()] * len(types)])], names)

        for b in batches:
            kind = [b.column(i).type for i in range(len(book))]
            for *k, t in T.rows(b):
                before = sums.setdefault(tuple(k), None)
                if t is not None:
                    sums[tuple(k)] = [x + sum(1 for _ in _places(c, t)) for c, x in zip(types, before or [0] * len(types))]
            if len(sums) > FLUSH_BOOKS:
                yield flush()
        if sums:
            yield flush()

    each = docs.select(*book, F.col(text).alias("__t")).mapInArrow(run, schema)
    return each.groupBy(*book).agg(*[F.sum(k).alias(k) for k in types]).unpivot(book, types, "type", "n")


def totals(docs: DataFrame, book: list[str], text: str = "text", unknown: DataFrame | None = None, per_type: int = PER_TYPE) -> DataFrame:
    """type, n, kept for each book: all records, and how many of them the cap leaves, without making any.

    unknown: the columns of book, word and n; a record of an unknown word is one of its n occurrences."""
    n = count_by_book(docs, book, text)
    if unknown is not None:
        n = n.unionByName(unknown.groupBy(*book).agg(F.sum("n").alias("n")).withColumn("type", F.lit("mot_inconnu")))
    return n.filter("n > 0").withColumn("kept", F.least("n", F.lit(per_type).cast("long")))


# --- records ---------------------------------------------------------------------------------------

_WORD, _ELIDED = re.compile(WORD), re.compile(ELIDED)
_LETTERS = frozenset(c for c in map(chr, range(0x100)) if re.fullmatch(L, c))


def _run_start(t: str, at: int, _: Callable) -> int:
    """Where the small letters before a place begin."""
    while at and t[at - 1] in _LETTERS:
        at -= 1
    return at


def _determiner(t: str, at: int, compiled: Callable) -> int:
    """Where the determiner before a comma begins, or -1."""
    m = compiled(rf"\b(?:{'|'.join(DETERMINERS)}) ?\Z").search(t, max(0, at - 8), at)
    return m.start() if m else -1


#: detector: what to search for, which begins with the rarest character of its pattern, and where a match with it begins, so many characters before or as a function says
ANCHORS: dict[str, tuple[str, int | Callable]] = {
    "min_apres_point": (rf"\. (?={L})", 0),
    "point_colle": (rf"\.(?<={L}{{2}}\.)(?={L})", 2),
    "det_virgule": (rf",(?= {L})", _determiner),
    "abrev_m": (r"M (?=[A-ZÀ-Ö])", 0),
    "quatre_points": (r"\.\.\.\.", 0),
    "espace_avant_point": (r" (?=[,.][ \n])", 1),
    "cesure_residuelle": (rf"- (?<={L}{{2}}- )(?={L}{{2}})", _run_start),
}


@functools.cache
def _compiled(pattern: str, odd: bool) -> re.Pattern:
    return re.compile(T.with_marks(pattern) if odd else pattern)


def _matches(kind: str, t: str, compiled: Callable) -> Iterator[re.Match]:
    """What finditer gives for a detector's pattern."""
    if kind not in ANCHORS:
        yield from compiled(PATTERNS[kind].replace("{2,})", "{2,}+)")).finditer(t)  # no shorter word can be followed by a space
        return
    anchor, before = ANCHORS[kind]
    match, end = compiled(PATTERNS[kind]).match, 0
    for h in compiled(anchor).finditer(t):
        at = h.start() - before if isinstance(before, int) else before(t, h.start(), compiled)
        if at >= end and (m := match(t, at)):
            end = m.end()
            yield m


def _places(kind: str, t: str) -> Iterator[re.Match | None]:
    """The matches of a detector without its exceptions; for guillemets None, once if they aren't balanced."""
    if kind == "guillemet_desequilibre":
        return iter([None] if t.count("«") != t.count("»") else [])
    compiled = functools.partial(_compiled, odd=T.ODD.search(t) is not None)
    return (m for m in _matches(kind, t, compiled) if not _excepted(kind, m, t, compiled))


RECORD = "type string, detector int, pos int, avant string, extrait string, apres string, suggestion string"


def _norm(w: str) -> str:
    return _ELIDED.sub("", unicodedata.normalize("NFC", w).lower().replace("’", "'"))


_normed = functools.lru_cache(1 << 17)(_norm)


def _suggestion(kind: str, m: re.Match) -> str | None:
    if kind == "point_colle":
        return m[0].replace(".", ". ", 1)
    return {"abrev_m": lambda: f"M. {m[1]}", "mot_double": lambda: m[1], "quatre_points": lambda: "…", "cesure_residuelle": lambda: m[1] + m[2]}.get(kind, lambda: None)()


def _excepted(kind: str, m: re.Match, t: str, compiled: Callable) -> bool:
    if kind == "min_apres_point":
        return bool(compiled(SHORTENED).search(t[max(0, m.start() - 8) : m.start() + 1]))
    if kind == "point_colle":
        return bool(compiled(DOMAIN).search(t[m.start() : m.start() + 12]))
    return (kind == "mot_double" and m[1] in DOUBLED) or (kind == "virgule_point" and m[0] == "..")


def find_type(kind: str, t: str, unknown: Collection[str] = ()) -> Iterator[tuple]:
    """(type, detector, pos, avant, extrait, apres, suggestion) of each anomaly of one type in a text."""

    def record(a: int, b: int, suggestion: str | None) -> tuple:
        return kind, TYPES.index(kind), a, t[max(0, a - CONTEXT) : a].lstrip(), t[a:b], t[b : b + CONTEXT].rstrip(), suggestion

    if kind == "mot_inconnu":
        rare = {w for w in set(_WORD.findall(t)) if _normed(w) in unknown} if unknown else ()
        if rare:
            for m in _WORD.finditer(t):
                if m[0] in rare:
                    yield record(m.start(), m.end(), None)
        return
    for m in _places(kind, t):
        if m is None:
            yield kind, TYPES.index(kind), 0, "", f"« ×{t.count('«')} vs » ×{t.count('»')}", "", None
        else:
            yield record(m.start(), m.end(), _suggestion(kind, m))


def find(t: str, unknown: Collection[str] = ()) -> Iterator[tuple]:
    """The records of find_type, detector by detector."""
    for kind in TYPES:
        yield from find_type(kind, t, unknown)


SHARED_WORDS = 200_000  # unknown words that may be broadcast


def records(docs: DataFrame, key: list[str], text: str = "text", unknown: DataFrame | None = None, lexicon: DataFrame | None = None, book: list[str] | None = None, shared_words: int = SHARED_WORDS) -> DataFrame:
    """The columns of key and a row for each anomaly of each document.

    unknown: the columns of book and word; a document gets those of its own words that are in it.  Up to shared_words
    of them are broadcast, so that texts stay where they are; of more, each document is joined with its own.
    lexicon: a rejoined hyphenated word is suggested only if it is in it (word); without a lexicon none is."""
    base, words_of = _with_words(docs, key, text, unknown, book, shared_words)
    schema, names = _schema(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield _batch([(*k, *r) for *k, t, w in T.rows(part) for r in find(t or "", words_of(k, w))], part, len(key), names)

    return _suggested(base.mapInArrow(run, schema), lexicon)


def _with_words(docs: DataFrame, key: list[str], text: str, unknown: DataFrame | None, book: list[str] | None, shared_words: int) -> tuple[DataFrame, Callable]:
    """The documents (key, text, words or null), and what gives the unknown words that are looked for in one, from its key and words."""
    base = docs.select(*key, F.col(text).alias("__t"), F.lit(None).cast("array<string>").alias("__w"))
    if unknown is None:
        return base, lambda _, w: w or ()
    rare = unknown.select(*book, "word").distinct()
    rows = rare.limit(shared_words + 1).collect()
    if len(rows) <= shared_words:
        sets: dict[tuple, set] = {}
        for *k, w in rows:
            sets.setdefault(tuple(k), set()).add(w)
        shared, at = docs.sparkSession.sparkContext.broadcast(sets), [key.index(k) for k in book]
        return base, lambda k, _: shared.value.get(tuple(k[i] for i in at), ())
    base = base.drop("__w")
    mine = base.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))).alias("form")).withColumn("word", norm_word("form"))
    rare = rare.select("word", *[F.col(c).alias(f"__{c}") for c in book])
    mine = mine.join(rare.withColumnRenamed("word", "__rare"), reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in book], F.col("word") == F.col("__rare")), "left_semi")
    mine = mine.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.collect_set("word").alias("__mine"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    return base.join(mine, same, "left").select(*key, "__t", F.col("__mine").alias("__w")), lambda _, w: w or ()


def _schema(docs: DataFrame, key: list[str]) -> tuple[str, list[str]]:
    kinds = dict(docs.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in key), RECORD]), [*key, *(x.split()[0] for x in RECORD.split(", "))]


def _batch(rows: list[tuple], like: pa.RecordBatch, n: int, names: list[str]) -> pa.RecordBatch:
    types = [*(like.column(i).type for i in range(n)), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)


def _suggested(out: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    hyphen = F.col("type") == "cesure_residuelle"
    if lexicon is None:
        return out.withColumn("suggestion", F.when(~hyphen, F.col("suggestion")))
    known = lexicon.select(F.col("word").alias("__joined")).distinct().withColumn("__known", F.lit(True))
    out = out.withColumn("__joined", F.when(hyphen, norm_word("suggestion"))).join(known, "__joined", "left")
    return out.withColumn("suggestion", F.when(~hyphen | F.col("__known"), F.col("suggestion"))).drop("__joined", "__known")


FLUSH_RECORDS = 200_000  # first records that a task holds before it passes them on


def first_records(
    docs: DataFrame, book: list[str], order: str, text: str = "text", unknown: DataFrame | None = None, lexicon: DataFrame | None = None, types: list[str] | None = None, per_type: int = PER_TYPE, shared_words: int = SHARED_WORDS
) -> DataFrame:
    """What capped leaves of records, all types or some: book, order and the first records of each type in each book.

    Each task passes on no more than the first of its own, and looks for a type only in documents that don't come after those.
    unknown: the columns of book, word and first (see unknown_words); the first records of unknown words are of those whose
    first documents are the first ones, so no others are looked for."""
    key, types = [*book, order], types or TYPES
    if unknown is not None:
        rank = F.rank().over(Window.partitionBy(*book).orderBy("first"))
        unknown = unknown.withColumn("__r", rank).filter(F.col("__r") <= per_type)
    base, words_of = _with_words(docs, key, text, unknown, book, shared_words)
    schema, names = _schema(docs, key)
    place = lambda r: (r[len(book)] is not None, r[len(book)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[tuple]] = {}
        last: dict[tuple, tuple] = {}
        like = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [r for found in kept.values() for r in sorted(found, key=lambda r: (place(r), r[len(key) + 2]))[:per_type]]
            kept.clear()
            last.clear()
            for i in range(0, len(rows), 5000):
                yield _batch(rows[i : i + 5000], like, len(key), names)

        for like in batches:
            for *k, t, w in T.rows(like):
                for kind in types:
                    group = (*k[: len(book)], kind)
                    if group in last and last[group] < place(k):
                        continue
                    new = [(*k, *r) for r in itertools.islice(find_type(kind, t or "", words_of(k, w) if kind == "mot_inconnu" else ()), per_type)]
                    if new:
                        found = kept.setdefault(group, [])
                        found += new
                        if len(found) >= 2 * per_type:
                            found.sort(key=lambda r: (place(r), r[len(key) + 2]))
                            del found[per_type:]
                            last[group] = place(found[-1])
            if sum(map(len, kept.values())) > FLUSH_RECORDS:
                yield from flush()
        if kept:
            yield from flush()

    return _suggested(capped(base.mapInArrow(run, schema), book, [order], per_type), lexicon)


def capped(found: DataFrame, book: list[str], order: list[str], per_type: int = PER_TYPE) -> DataFrame:
    """The first records of each type in each book."""
    w = Window.partitionBy(*book, "type").orderBy(*order, "pos")
    return found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_type).drop("__n")


def statistics(found: DataFrame, book: list[str]) -> DataFrame:
    """type, n of all records, capped or not, by book."""
    return found.groupBy(*book, "type").agg(F.count("*").alias("n"))
