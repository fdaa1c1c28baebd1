"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import cotrain, decontam, langid, licenses, maskedlm, mtree, neardup, spiece, tokenstore, toxicity
from quillspark.sources import tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name, spread=name in ("documents", "embeddings"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(_table(spark, sf_dir, "documents"))


def op2_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(_table(spark, sf_dir, "documents"), windows=True)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.pack(_table(spark, sf_dir, "documents"))


def op3_token_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's own rows decoded with the dictionary among them."""
    return tokenstore.decode(tokenstore.pack(_table(spark, sf_dir, "documents"))).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text"), (F.col("n_tokens") > 0).alias("some"))


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode(_table(spark, sf_dir, "documents"))


def op6_sentencepiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded as they stand, without a map, and decoded again."""
    encoded = spiece.encode(_table(spark, sf_dir, "documents"), normal=False)
    return spiece.decode(encoded).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(_table(spark, sf_dir, "documents"))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskedlm.score(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_license_scan,
        op2_license_windows,
        op3_token_store,
        op3_token_decode,
        op4_quality_cotraining,
        op5_exact_top_k,
        op6_sentencepiece,
        op6_sentencepiece_decode,
        op7_toxicity,
        op8_minhash_near_dedup,
        op9_masked_lm,
        op10_language_id,
    )
}
ORACLE = {
    "op3_token_decode": "select doc_id, md5(text) as text, length(text) > 0 as some from documents",
    "op6_sentencepiece_decode": "select doc_id, md5(replace(text, '▁', ' ')) as text from documents",
    "op2_license_scan": licenses.sql(), "op5_exact_top_k": mtree.sql(),
}
