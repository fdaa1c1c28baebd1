"""Incremental audit: new documents are counted as they arrive, each once, and their counters appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text as T
from quillspark.operators import audit
from quillspark.sources import library

BOOK = "path string, modificationTime timestamp, length long, content binary"


def audit_stream(docs: DataFrame, key: list[str], text: str, out: str, checkpoint: str) -> StreamingQuery:
    """Counters of a stream of plain texts, appended to out; a document whose key is there already isn't counted again.

    The stream keeps no state of its own: what is done is read from out, as a batch run does."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        try:
            fresh = fresh.join(spark.read.parquet(out).select(*key), key, "left_anti")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        carried = [c for c in batch.columns if c != text and c not in audit.TEXT_COUNTERS]
        fresh.select(*carried, audit.counted(F.col(text)).alias("__c")).select(*carried, "__c.*").write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def library_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Audit of e-books as they appear in a folder, one record a book, named by its path; broken books give an error."""
    raw = spark.readStream.format("binaryFile").schema(BOOK).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("maxFilesPerTrigger", per_trigger).load(folder)

    def append(batch: DataFrame, _: int) -> None:
        books = batch.select(F.xxhash64("path").alias("id"), "path", F.col("length").alias("size"), "content").dropDuplicates(["id"])
        unpacked = library.entries(books, library.DOCS_ONLY)
        bad = library.failures(unpacked)
        books = books.drop("content").join(bad, "id", "left")
        audit.audit_library(books, unpacked.filter("ord >= 0")).write.mode("append").parquet(out)

    return raw.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_marks(events: DataFrame, time: str, text: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Straight apostrophes and characters by window of arrival; late rows beyond the watermark are dropped."""
    rows = events.withWatermark(time, late).select(F.window(time, width).alias("w"), T.count_of(text, "'").alias("a"), F.length(text).alias("c"))
    return rows.groupBy("w").agg(F.sum("a").alias("apos_straight"), F.sum("c").alias("chars")).select("w.start", "w.end", "apos_straight", "chars")
