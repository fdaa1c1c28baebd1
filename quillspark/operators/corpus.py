"""Corpus tools: lexicon by document frequency, candidates for À, chapter texts, overlapping reading windows, positional samples."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.rules import A_CANDIDATE

MIN_BOOKS = 2
_SMALL = "a-zà-öø-ÿœæ"
LEXICON_WORD = f"[{_SMALL}]+(?:[-'’][{_SMALL}]+)*"
TARGET, OVERLAP = 25_000, 400
FRONT_MATTER = "cover|titlepage|copyright|nav|toc"


# --- lexicon -------------------------------------------------------------------------------------


FLUSH = 500_000  # distinct words that a task holds before it passes them on
PASSED = 20_000  # of them made into rows at a time


def lexicon(docs: DataFrame, book: list[str], text: str = "text", min_books: int = MIN_BOOKS) -> DataFrame:
    """word, books: forms found in at least min_books books; text is lower-cased here.

    Each task passes on a word of a book once, however many documents hold it; a form is counted once a book."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in book), "word string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, set[str]] = {}
        kind: list[pa.DataType] = []
        cut = re.compile(LEXICON_WORD).findall

        def flush() -> Iterator[pa.RecordBatch]:
            rows = ((*k, w) for k, ws in found.items() for w in ws)
            while part := list(itertools.islice(rows, PASSED)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), [*kind, pa.string()])], [*book, "word"])
            found.clear()

        for b in batches:
            kind = [b.column(i).type for i in range(len(book))]
            held = sum(map(len, found.values()))
            for *k, t in T.rows(b):
                if t:
                    words = found.setdefault(tuple(k), set())
                    held -= len(words)
                    words.update(cut(t.lower().replace("’", "'")))
                    held += len(words)
                    if held > FLUSH:
                        yield from flush()
                        held = 0
        if found:
            yield from flush()

    forms = docs.select(*book, F.col(text).alias("__t")).mapInArrow(run, schema).distinct()
    return forms.groupBy("word").agg(F.count("*").alias("books")).filter(F.col("books") >= min_books)


def chosen(inventory: DataFrame, ids: DataFrame) -> DataFrame:
    """Books of an inventory whose id is listed (ids: id)."""
    return inventory.join(ids.select("id").distinct(), "id", "left_semi")


def pending(inventory: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Books that have no result yet."""
    return inventory.join(done.select(key).dropna().distinct(), key, "left_anti")


# --- candidates ---------------------------------------------------------------------------------------


def candidates(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, idx, avant, apres for each isolated A before a small letter, numbered within the document.

    One Arrow pass that searches for the letter; only what is shown of a text leaves it."""
    kinds, names = dict(docs.dtypes), [*key, "idx", "avant", "apres"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "idx int, avant string, apres string"])
    pattern = A_CANDIDATE.replace("(?U)", "").replace(r"\bA", r"A(?<=\bA)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, odd = re.compile(pattern), re.compile(T.with_marks(pattern))
        for b in batches:
            types = [*(b.column(i).type for i in range(len(key))), pa.int32(), pa.string(), pa.string()]
            for i in range(0, b.num_rows, 256):
                rows = []
                for *k, t in T.rows(b.slice(i, 256)):
                    found = (odd if T.ODD.search(t) else plain).finditer(t) if t else ()
                    rows += [(*k, n, t[max(0, m.start() - 60) : m.start()].lstrip(), t[m.start() : m.start() + 70].rstrip()) for n, m in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    return docs.select(*key, F.col(text).alias("__t")).mapInArrow(run, schema)


def approved(candidates_: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that a reviewer approved (decisions: key, idx, accentuer)."""
    return candidates_.join(decisions.filter("accentuer").select(*key, "idx").distinct(), [*key, "idx"], "left_semi")


# --- chapters and windows --------------------------------------------------------------------------------


def chapters(docs: DataFrame, markup: str = "html", min_chars: int = 100) -> DataFrame:
    """docs with text and chars, without those that are too short."""
    return docs.withColumn("text", T.text_chapter(markup)).withColumn("chars", F.length("text")).filter(F.col("chars") >= min_chars)


def _cut(text: Column, target: int, overlap: int, separator: str) -> Column:
    """Windows of a text: whole paragraphs until the target is reached; the next begins with the end of the last."""
    paragraphs = F.split(text, F.lit("\\Q" + separator + "\\E"))
    mark = lambda chunk: F.concat(F.lit("[…suite — contexte précédent : …"), F.when(F.length(chunk) > overlap, F.right(chunk, F.lit(overlap))).otherwise(chunk), F.lit("]"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(a: Column, p: Column) -> Column:
        open_ = F.concat(a["open"], F.array(p))
        size = a["size"] + F.length(p) + 2
        chunk = F.array_join(open_, separator)
        full = size >= target
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(chunk))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(mark(chunk))).otherwise(open_).alias("open"),
            F.when(full, 0).otherwise(size).alias("size"),
        )

    def last(a: Column) -> Column:
        some = F.exists(a["open"], lambda p: T.strip(p) != "")
        return F.when(some, F.concat(a["done"], F.array(F.array_join(a["open"], separator)))).otherwise(a["done"])

    return F.aggregate(paragraphs, start, step, last)


def windows(docs: DataFrame, key: list[str], text: str = "text", target: int = TARGET, overlap: int = OVERLAP, separator: str = "\n\n") -> DataFrame:
    """key, k (from 1), of, chunk, chars: overlapping windows of each text, cut between paragraphs.

    Texts under the target, nearly all of them, are one window as they stand and skip the fold."""
    t = F.col(text)
    # a paragraph adds its length and 2: with a shorter separator the sum exceeds the length of the text
    bound = F.length(t) + (2 - len(separator)) * (F.length(t) - F.length(F.replace(t, F.lit(separator), F.lit("")))) / len(separator) + 2
    short = docs.filter(bound < target).filter(T.strip(t) != "").select(*key, F.array(t).alias("__w"))
    long = docs.filter(bound >= target).select(*key, _cut(t, target, overlap, separator).alias("__w"))
    out = short.unionByName(long)
    return out.select(*key, F.size("__w").alias("of"), F.posexplode("__w").alias("k0", "chunk")).select(*key, (F.col("k0") + 1).alias("k"), "of", "chunk", F.length("chunk").alias("chars"))


def numbered(windows_: DataFrame, book: list[str], order: list[str]) -> DataFrame:
    """Windows with their running number w in the book."""
    return windows_.withColumn("w", F.row_number().over(Window.partitionBy(*book).orderBy(*order, "k")))


# --- samples -----------------------------------------------------------------------------------------------


def samples(docs: DataFrame, book: list[str], name: str = "name", text: str = "text", limit: int = 1500, short: int = 200) -> DataFrame:
    """book, place, name, extract: of each book the second document, the middle one and the last but one, by name.

    A short text gives way to the first of the next three that isn't; if none is,
    to the last of those tried, under the first one's name.  Front matter is left out unless there is nothing else."""
    by = Window.partitionBy(*book)
    front = F.lower(F.col(name)).rlike(FRONT_MATTER)
    # only what can be shown of a text, and its length, goes through the shuffle
    d = docs.select(*book, F.col(name).alias("__name"), F.substring(text, 1, limit).alias("__t"), F.length(text).alias("__len"), front.cast("int").alias("__front"))
    d = d.withColumn("__only", F.min("__front").over(by)).filter(F.col("__front") == F.col("__only"))
    order = by.orderBy("__name")
    d = d.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(by))
    this = F.struct(F.col("__t").alias("t"), F.col("__name").alias("n"), F.col("__len").alias("len"))
    d = d.select("*", *[F.lead(this, k).over(order).alias(f"__{k}") for k in (1, 2, 3)])
    n, i = F.col("__n"), F.col("__i")
    replace = (F.col("__len") < short) & (n > 5)
    pick = F.when(~replace, this)
    for k in (1, 2, 3):
        pick = pick.when(F.col(f"__{k}.len") >= short, F.col(f"__{k}"))
    last = F.coalesce("__3", "__2", "__1", this)
    pick = pick.otherwise(F.struct(last["t"].alias("t"), F.col("__name").alias("n"), last["len"].alias("len")))
    chosen_ = (i == F.least(F.lit(1), n - 1)) | (i == F.floor(n / 2)) | (i == F.when(n > 2, n - 2).otherwise(n - 1))
    return d.filter(chosen_).select(*book, i.cast("int").alias("place"), pick["n"].alias("name"), pick["t"].alias("extract"))
