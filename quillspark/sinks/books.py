"""Sinks: e-books, reports, text files of chapters, windows and samples, line formats.

File sinks write each file under the attempt's own name and rename it, so a
lost and repeated task leaves whole files; the folder must be shared by all executors.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.apply import inline_diff


def packed(entries: DataFrame) -> DataFrame:
    """book_id, content: an e-book of each book's entries (book_id, ord, name, bytes, zdate), the type first and stored, the rest deflated in order."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
            for e in f.sort_values("ord").itertuples(index=False):
                if e.name != "mimetype":
                    info = zipfile.ZipInfo(e.name, tuple(int(x) for x in e.zdate)) if e.zdate is not None else zipfile.ZipInfo(e.name)
                    z.writestr(info, e.bytes or b"", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"book_id": [f["book_id"].iloc[0]], "content": [buffer.getvalue()]})

    kept = entries.filter("ord >= 0").select("book_id", "ord", "name", "bytes", "zdate")
    return kept.groupBy("book_id").applyInPandas(pack, "book_id long, content binary")


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes content (text or bytes) of each row under its name below the folder; gives name and size of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = []
            for n, c in zip(f["name"], f["content"]):
                path = os.path.join(folder, n)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                data = c.encode() if isinstance(c, str) else bytes(c)
                temporary = f"{path}.{os.getpid()}.part"
                with open(temporary, "wb") as out:
                    out.write(data)
                os.replace(temporary, path)
                sizes.append(len(data))
            yield pd.DataFrame({"name": f["name"], "size": sizes})

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, "name string, size long")


# --- reports -------------------------------------------------------------------------------------------


def ranking_csv(classified: DataFrame) -> DataFrame:
    """The columns of the ranking report; write it with .write.csv(header=True)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return classified.select(
        F.col("cls").alias("classe"), "score", "id", F.col("title").alias("titre"), text("authors").alias("auteurs"), text("readers").alias("lecteurs"), F.concat_ws(" | ", "defects").alias("defauts")
    )


def console_lines(classified: DataFrame) -> DataFrame:
    """A line for each book that has a defect, with its defects below."""
    head = F.format_string("[%s] %6.1f  #%-5d %-55s (%s)", "cls", "score", "id", F.left("title", F.lit(55)), F.coalesce(F.nullif("readers", F.lit("")), F.lit("—")))
    return classified.filter(~F.col("cls").isin("OK", "IMG")).select("id", F.concat(head, F.array_join(F.transform("defects", lambda d: F.concat(F.lit("\n          - "), d)), "")).alias("line"))


def _clip(c: str, n: int) -> Column:
    return F.left(F.col(c), F.lit(n))


def _blank(c: str, other: str = "") -> Column:
    return F.coalesce(F.col(c), F.lit(other))


def report_markdown(outcomes: DataFrame, budgets: DataFrame, book: list[str], doc: str = "doc") -> DataFrame:
    """book, report: all outcomes of each book as Markdown."""
    applied = F.concat(
        F.format_string("- **%s** [%s] %s\n", F.col(doc), _blank("source", "?"), _blank("raison")),
        F.format_string("  - avant : `…%s%s%s…`\n", "before", "actual", "after"),
        F.format_string("  - `%s` → `%s`\n", "chercher", "remplacer"),
    )
    rejected = F.format_string("- **%s** `%s` → `%s` — %s\n", F.col(doc), _clip("chercher", 60), _clip("remplacer", 60), F.col("reason"))
    line = F.struct(F.col(doc).alias("d"), F.col("seq").alias("s"), F.when(F.col("status") == "applied", applied).otherwise(rejected).alias("t"))
    group = outcomes.groupBy(*book).agg(*[F.sort_array(F.collect_list(F.when(F.col("status") == s, line))).alias(s) for s in ("applied", "rejected")])
    text = lambda s: F.array_join(F.transform(s, lambda x: x["t"]), "")
    head = F.format_string("%d appliquées / %d rejetées (budget %d sur ~%d mots)\n\n## Appliquées\n\n", F.size("applied"), F.size("rejected"), "budget", "words")
    return group.join(budgets, book).select(*book, F.concat(F.lit("# Corrections OCR\n\n"), head, text("applied"), F.lit("\n## Rejetées\n\n"), text("rejected")).alias("report"))


def report_html(outcomes: DataFrame, budgets: DataFrame, book: list[str], doc: str = "doc", title: str = "") -> DataFrame:
    """book, report: all outcomes of each book as an HTML page, changes marked."""
    chapter = T.escape(T.sub(doc, r"^.*/|\.x?html?$", ""))
    cell = lambda cls, c: F.concat(F.lit(f'<td class="{cls}">'), c, F.lit("</td>"))
    context = F.concat(F.lit("…"), T.escape("before"), F.lit('<span class="hit">'), inline_diff("actual", "chercher", "remplacer"), F.lit("</span>"), T.escape("after"), F.lit("…"))
    doubt = F.when(F.contains(_blank("source"), F.lit("moyenne")), F.lit(' <span class="conf">confiance moyenne</span>')).otherwise("")
    badge = F.when(_blank("source").startswith("lecture"), "ocr").otherwise("règle")
    applied = F.concat(cell("doc", chapter), cell("ctx", context), cell("raison", F.concat(T.escape(_blank("raison")), doubt)), cell("src", badge))
    proposal = F.concat(F.lit("<del>"), T.escape(_clip("chercher", 80)), F.lit("</del> → <ins>"), T.escape(_clip("remplacer", 80)), F.lit("</ins>"))
    rejected = F.concat(cell("doc", chapter), cell("ctx", proposal), cell("raison", T.escape("reason")))
    rows = outcomes.select(*book, F.col(doc).alias("d"), F.col("seq").alias("s"), "status", F.when(F.col("status") == "applied", applied).otherwise(rejected).alias("t"))
    line = F.struct("d", "s", "t")
    group = rows.groupBy(*book).agg(*[F.sort_array(F.collect_list(F.when(F.col("status") == s, line))).alias(s) for s in ("applied", "rejected")])
    many = F.array_join(F.transform("applied", lambda x, i: F.concat(F.lit('<tr><td class="n">'), (i + 1).cast("string"), F.lit("</td>"), x["t"], F.lit("</tr>"))), "")
    refused = F.array_join(F.transform("rejected", lambda x: F.concat(F.lit("<tr>"), x["t"], F.lit("</tr>"))), "")
    style = "del{color:#b30000;background:#fee}ins{color:#060;background:#efe}table{border-collapse:collapse;width:100%}td{border-top:1px solid #ddd;padding:5px}"
    head = f'<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>Corrections</title><style>{style}</style></head><body><h1>Corrections appliquées</h1>'
    summary = F.format_string("<p>%d appliquées · %d rejetées · budget %d sur ≈%d mots.</p>", F.size("applied"), F.size("rejected"), "budget", "words")
    page = F.concat(F.lit(head), F.lit(f"<h2>{title}</h2>"), summary, F.lit("<table>"), many, F.lit("</table><h1>Rejetées</h1><table>"), refused, F.lit("</table></body></html>"))
    return group.join(budgets, book).select(*book, page.alias("report"))


# --- texts ----------------------------------------------------------------------------------------------------


def chapter_files(chapters: DataFrame, name: str = "name") -> DataFrame:
    """file, content, and the index fields doc, chars of each chapter (name, text, chars)."""
    return chapters.select(F.concat(F.replace(F.col(name), F.lit("/"), F.lit("_")), F.lit(".txt")).alias("file"), F.concat(F.lit("### DOC: "), name, F.lit("\n\n"), "text").alias("content"), F.col(name).alias("doc"), "chars")


def window_files(windows: DataFrame, book: str = "livre", doc: str = "doc") -> DataFrame:
    """file, content, and the index fields of each numbered window."""
    file = F.format_string("%s-w%03d.txt", F.col(book).cast("string"), "w")
    head = F.format_string("### LIVRE %s — DOC: %s — fenêtre %d/%d\n\n", F.col(book).cast("string"), F.col(doc), "k", "of")
    return windows.select(file.alias("file"), F.concat(head, "chunk").alias("content"), book, doc, "chars")


def sample_files(samples: DataFrame, books: DataFrame) -> DataFrame:
    """file, content for each book (id, title, authors): its extracts under a heading."""
    part = F.struct("place", F.concat(F.lit("\n## Extrait — "), "name", F.lit("\n\n"), "extract").alias("t"))
    group = samples.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    head = F.format_string("# %s — %s (id %d)", "title", F.coalesce("authors", F.lit("")), "id")
    return books.join(group, "id").select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("file"), F.concat_ws("\n", head, F.transform("p", lambda x: x["t"])).alias("content"))


def lexicon_text(lexicon: DataFrame) -> DataFrame:
    """The words in order, for .write.text."""
    return lexicon.select("word").orderBy("word")


# --- lines ----------------------------------------------------------------------------------------------


def append_lines(df: DataFrame, folder: str, key: list[str]) -> None:
    """Appends the rows to a folder of JSON lines, but for those whose key is there already: a run that is repeated goes on where it stopped."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        kinds = dict(df.dtypes)
        df = df.join(spark.read.json(folder, schema=", ".join(f"`{k}` {kinds[k]}" for k in key)), key, "left_anti")
    df.write.mode("append").json(folder)


def index_json(files: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """content: the index of written chapters or windows (chapter_files, window_files), a JSON array of the fields in order."""
    row = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*fields)).alias("__j"))
    return files.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["__j"]), ", "), F.lit("]")).alias("content"))


def counters_in_order(totals: DataFrame, names: list[str]) -> DataFrame:
    """name, n: the totals of the named columns, by name."""
    return totals.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).unpivot([], sorted(names), "name", "n").orderBy("name")


def first_problems(fixed: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    """The first problems of a run of the fixer, as its report shows them."""
    return fixed.filter("problem is not null").orderBy(*order).limit(limit).select(*order, "problem")
