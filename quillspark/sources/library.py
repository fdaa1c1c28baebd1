"""Sources: folders and inventories of e-books, their entries, and the line formats that stages exchange."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.audit import COUNTERS

INVENTORY = "id long, path string, name string, title string, authors string, readers string, lang_db string"
ENTRY = "book_id long, ord int, name string, bytes binary, zdate array<int>"
DOCS_ONLY = r"(?i)\.(?:xhtml|html|htm|opf|ncx)$"
AUDIT = (
    "id long, path string, name string, title string, authors string, readers string, lang_db string, size long, error string, lang_opf string, epub_version string, n_docs int, n_css int, n_fonts int, "
    "n_images int, has_ncx boolean, has_nav boolean, fixed_layout boolean, encoding_issues int, " + ", ".join(f"{c} long" for c in COUNTERS)
)
CANDIDATE = "doc string, idx int, avant string, apres string"
DECISION = "doc string, idx int, accentuer boolean"
ANOMALY = "doc string, type string, avant string, extrait string, apres string, suggestion string"
CORRECTION = "doc string, chercher string, remplacer string, raison string, source string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder, without extension), size, content of all e-books; content is read only where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(folder)
    return raw.select(F.col("path").alias("uri"), F.col("length").alias("size"), "content")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """An inventory of a folder: running id by folder, then file name; only paths are sorted."""
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("uri", "^file:/*", "/"), "^.*?" + _quoted(base) + "/?", "")
    rel = F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B")))
    f = files(spark, folder).select(rel.alias("rel"))
    directory = F.regexp_extract("rel", "^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"(?i)\.epub$", "")
    order = Window.orderBy("path", "file")
    f = f.select(directory.alias("path"), F.element_at(F.split("rel", "/"), -1).alias("file"), stem.alias("name"))
    empty = F.lit("")
    return f.select(F.row_number().over(order).cast("long").alias("id"), "path", "name", F.col("name").alias("title"), empty.alias("authors"), empty.alias("readers"), empty.alias("lang_db"))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated inventory; the last three columns may be missing."""
    raw = spark.read.csv(path, sep="\t", quote="", schema=INVENTORY, mode="PERMISSIVE")
    return raw.filter("id is not null").fillna("", ["path", "name", "title", "authors", "readers", "lang_db"])


def library(spark: SparkSession, folder: str, books: DataFrame) -> DataFrame:
    """Inventory rows with size, content, and error where the file (lower-case extension) isn't there."""
    f = files(spark, folder).withColumn("uri", F.url_decode(F.replace(F.regexp_replace("uri", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))))
    want = F.concat_ws("/", F.lit(folder.rstrip("/")), F.nullif("path", F.lit("")), F.concat("name", F.lit(".epub")))
    joined = books.withColumn("uri", want).join(f, "uri", "left").drop("uri")
    return joined.withColumn("error", F.when(F.col("size").isNull(), F.lit("epub_not_found")))


def entries(books: DataFrame, names: str | None = None) -> DataFrame:
    """Entries (book_id, ord, name, bytes, zdate) of books (id, content); names: a pattern, so that other entries aren't unpacked.

    A broken container gives one row with ord -1 and the message as its name."""
    pattern = re.compile(names) if names else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, content in zip(f["id"], f["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for k, i in enumerate(z.infolist()):
                            want = pattern is None or pattern.search(i.filename)
                            rows.append((book, k, i.filename, z.read(i) if want else None, list(i.date_time)))
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError, NotImplementedError) as e:
                    rows = [(book, -1, f"{type(e).__name__}: {e}", None, None)]
                yield pd.DataFrame(rows, columns=["book_id", "ord", "name", "bytes", "zdate"])

    return books.filter("content is not null").select("id", "content").mapInPandas(run, ENTRY)


def failures(entries_: DataFrame) -> DataFrame:
    """id, error of the books that couldn't be unpacked."""
    return entries_.filter("ord < 0").select(F.col("book_id").alias("id"), F.col("name").alias("error"))


def lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines of a fixed schema, with the file and the order of lines in it; blank and broken lines are left out."""
    raw = spark.read.json(paths, schema=schema + ", _broken string", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord")]
    return raw.select("*", *place).filter("_broken is null").drop("_broken")


def corrections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Corrections of several files, in the order of the files' names and their lines."""
    got = lines(spark, paths, CORRECTION)
    order = Window.partitionBy("doc").orderBy("file", "block", "ord")
    return got.withColumn("ord", F.row_number().over(order).cast("long")).drop("file", "block")


def decisions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return lines(spark, paths, DECISION).filter("accentuer").select("doc", "idx").distinct()


def words(spark: SparkSession, path: str) -> DataFrame:
    """word: a list of words, one a line, plain or compressed."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()


def ids(spark: SparkSession, path: str) -> DataFrame:
    """id: the numbers of a list, one a line, each once and in order."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) as long)").alias("id")).dropna().distinct().orderBy("id")


def audits(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of JSON lines as sinks.books.append_lines writes them, the last of each book; fields that a record lacks are null."""
    got = lines(spark, path, AUDIT)
    return got.groupBy("id").agg(F.max_by(F.struct(*[c for c in got.columns if c not in ("id", "file", "block", "ord")]), F.struct("file", "block", "ord")).alias("r")).select("id", "r.*")


def readable(docs: DataFrame, content: str = "bytes") -> DataFrame:
    """docs without those whose content isn't UTF-8."""
    return docs.filter(T.is_utf8(content))
