"""The chains of operators that make up a treatment: audit and rank, fix, detect and apply, finish a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import anomalies, apply, audit, boilerplate, rules, score
from quillspark.sinks import books as sink


def audit_and_rank(books: DataFrame, entries: DataFrame) -> DataFrame:
    """Audit records of a library, classified and ranked."""
    return score.ranked(score.classify(audit.audit_library(books, entries)), "id")


def _with_bytes(entries: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """entries with the text of docs (book_id, ord) as their bytes, other entries as they are."""
    new = docs.select("book_id", "ord", F.encode(F.col(text), "UTF-8").alias("__b"))
    return entries.join(new, ["book_id", "ord"], "left").withColumn("bytes", F.coalesce("__b", "bytes")).drop("__b")


def fix_library(entries: DataFrame, facts: DataFrame, force: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries after the rules, a row of counts for each book, refused books); facts: book_id, lang_opf."""
    ok, refused = rules.language_gate(facts, force=force)
    mine = entries.join(ok.select("book_id"), "book_id", "left_semi")
    docs = mine.filter(T.is_doc("name")).select("book_id", "ord", F.col("name").alias("doc"), T.decoded("bytes").alias("html"), (~T.is_utf8("bytes")).cast("long").alias("encodage_latin1_converti"))
    fixed = rules.fix_documents(docs, **options)
    converted = fixed.groupBy("book_id").agg(F.sum("encodage_latin1_converti").alias("encodage_latin1_converti"))
    return _with_bytes(mine, fixed, "fixed"), rules.rule_totals(fixed, ["book_id"]).join(converted, "book_id"), refused


def detect(docs: DataFrame, key: list[str], book: list[str], lexicon: DataFrame | None = None, dictionary: DataFrame | None = None, per_type: int = anomalies.PER_TYPE) -> tuple[DataFrame, DataFrame]:
    """(capped records, uncapped statistics) of the anomalies of marked-up docs (key, html)."""
    texts = docs.select(*key, T.text_anomaly("html").alias("text"))
    unknown = anomalies.unknown_words(texts, book, lexicon, dictionary)
    found = anomalies.records(texts, key, "text", unknown, lexicon, book)
    return anomalies.capped(found, book, [k for k in key if k not in book], per_type), anomalies.statistics(found, book)


def apply_to_library(entries: DataFrame, corrections: DataFrame, percent: float = 0.2) -> tuple[DataFrame, apply.Applied]:
    docs = entries.filter(T.is_doc("name")).select("book_id", "ord", F.col("name").alias("doc"), T.decoded_with_marks("bytes").alias("html"))
    done = apply.apply_corrections(docs, corrections, ["book_id"], percent=percent)
    changed = done.docs.join(done.outcomes.filter("status = 'applied'").select("book_id", "doc").distinct(), ["book_id", "doc"], "left_semi")
    return _with_bytes(entries, changed, "fixed"), done


def strip_library(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries without boilerplate, their navigation and package repaired; totals by book)."""
    docs = entries.filter(T.is_doc("name")).select("book_id", "ord", "name", T.decoded_with_marks("bytes").alias("html"))
    done = boilerplate.strip_documents(docs)
    base = F.element_at(F.split("name", "/"), -1)
    gone = done.filter("dropped").groupBy("book_id").agg(F.collect_set(base).alias("__gone"))
    alive = boilerplate.surviving_anchors(done, ["book_id"]).groupBy("book_id").agg(F.collect_set("anchor").alias("__alive"))
    out = _with_bytes(entries, done, "stripped").join(gone, "book_id", "left").join(alive, "book_id", "left")
    out = out.filter(F.col("__gone").isNull() | ~T.is_doc("name") | ~F.array_contains("__gone", base))
    text = T.decoded_with_marks("bytes")
    ncx, opf = F.col("name").rlike(r"(?i)\.ncx$"), F.col("name").rlike(r"(?i)\.opf$") & F.col("__gone").isNotNull()
    rest = out.filter(~(ncx | opf))
    nav = out.filter(ncx).withColumn("bytes", F.encode(boilerplate.pruned_navigation(text, F.col("__alive"), F.col("__gone")), "UTF-8"))
    pack = out.filter(opf).withColumn("bytes", F.encode(boilerplate.pruned_package(text, F.col("__gone")), "UTF-8"))
    return rest.unionByName(nav).unionByName(pack).drop("__gone", "__alive"), boilerplate.strip_totals(done, ["book_id"])


def clean_library(entries: DataFrame, meta: boilerplate.Metadata) -> DataFrame:
    text = T.decoded_with_marks("bytes")
    new = (
        F.when(F.col("name").rlike(r"(?i)\.opf$"), F.encode(boilerplate.clean_package(text, meta), "UTF-8"))
        .when(F.col("name").rlike(r"(?i)\.ncx$"), F.encode(boilerplate.navigation_id(text, meta), "UTF-8"))
        .otherwise(F.col("bytes"))
    )
    return entries.withColumn("bytes", new)


def finish_collection(entries: DataFrame, books: DataFrame, corrections: DataFrame, meta: boilerplate.Metadata, percent: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(book_id, content of the finished e-books; the manifest: proposed, applied and rejected corrections and the audit of the result)."""
    applied, done = apply_to_library(entries, corrections, percent)
    final = clean_library(applied, meta)
    counts = done.outcomes.groupBy("book_id").agg(F.count_if(F.col("status") == "applied").alias("appliquees"), F.count_if(F.col("status") == "rejected").alias("rejetees"))
    again = audit.audit_library(books, final)
    manifest = again.select(
        F.col("id").alias("book_id"), F.col("title").alias("titre"), F.col("apos_straight").alias("apos_droites"), F.col("apos_curly").alias("apos_courbes"), "dlg_hyphen", "dlg_emdash", "mojibake", "chars"
    )
    manifest = manifest.join(done.budgets.select("book_id", F.col("asked").alias("corrections_proposees")), "book_id", "left").join(counts, "book_id", "left")
    manifest = manifest.fillna(0, ["corrections_proposees", "appliquees", "rejetees"]).withColumn("titre", F.coalesce("titre", F.lit("")))
    return sink.packed(final), manifest


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("books"), *[F.sum(c).alias(c) for c in ("corrections_proposees", "appliquees", "rejetees", "chars")])
