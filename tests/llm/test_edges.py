"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage: results as the docstrings define them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import cotrain, decontam, langid, licenses, maskedlm, mtree, neardup, spiece, tokenstore, toxicity

LONG = "le chat noir dort sous la table verte pendant que la pluie tombe " * 4000
ROWS = [
    (1, None, None, None, None),
    (2, "", "fr", "", 0),
    (3, "the cat sat on the mat and the dog ran away", "en", "s", 43),
    (3, "the cat sat on the mat and the dog ran away", "en", "s", 43),
    (None, "der hund lief weg und die katze schlief ein", "de", None, -5),
    (4, "you are an idiot and i will kill you", "en", "s", 36),
    (5, LONG, "fr", "s", len(LONG)),
    (6, "  \n ", "en", "s", 4),
    (6, "another text of the same id which is quite different", "en", "s", 51),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["key", "rep", "score", "bands", "ids", "deal", "x", "y", "m", "fold", "c", "h", "item_id", "toxic", "root", "a", "b", "n", "u", "v"]
LABELS = [(3, 1, 0), (3, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (2, 0, 0), (9, 1, 0)]
ITEMS = [(1, "the cat sat on the mat and the dog ran away"), (1, "the cat sat on the mat and the dog ran away"), (2, None), (3, ""), (None, "katze")]
PAGES = [(1, "http://a.b/en/3.html", "<p>x</p>"), (2, "https://c.d/3", None), (3, None, "<p>"), (4, "http://a.b/en/none", "")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_decontamination(spark, docs, tables):
    got = rows(decontam.leaks(docs, read(spark, tables, "benchmark")))
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got} == {(3, 1, 1.0), (None, None, 1.0)} and len(got) == 2
    left = decontam.remove_leaks(docs, read(spark, tables, "benchmark"))
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontam.leaks(docs, read(spark, tables, "benchmark").limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), read(spark, tables, "benchmark")).count() == 0


def test_licenses(spark, docs):
    assert rows(licenses.find(docs)) == []
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (2, None)], "doc_id long, text string")
    got = [r for r in rows(licenses.find(df)) if r["kind"] == "line"]
    assert [(r["doc_id"], r["kind"], r["segment"], r["dice"]) for r in got] == [(1, "line", 1, 1.0)] * 2
    assert licenses.find(df.limit(0)).count() == 0


def test_token_store(docs):
    packed = tokenstore.pack(docs)
    got = [r for r in rows(packed) if r["shard"] >= 0]
    assert len(got) == len(ROWS) and len({r["dict_hash"] for r in rows(packed)}) == 1
    dictionary = tokenstore.dictionary_of(packed)
    for r, src in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"] or 0)), sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or "")))):
        ids = tokenstore.unpack(r["blob"], dictionary, expected=r["dict_hash"])
        assert (r["n_tokens"] is None) == (src[1] is None)
        assert tokenstore.tokenizer().decode(ids) == (src[1] or "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows(tokenstore.decode(packed))) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    empty = tokenstore.pack(docs.limit(0))
    assert [(r["shard"], r["blob"]) for r in rows(empty)] == [(-1, b"")] and tokenstore.decode(empty).count() == 0


def test_cotraining(spark, docs, tables):
    pages, labels = read(spark, tables, "pages"), read(spark, tables, "labels")
    assert cotrain.score(docs, pages, labels).count() == len(ROWS)
    none = rows(cotrain.score(docs, pages, labels.limit(0)))
    assert len(none) == len(ROWS) and {r["quality_prob"] for r in none} == {0.5} and all(r["keep"] for r in none)
    assert cotrain.score(docs.limit(0), pages.limit(0), labels).count() == 0


def test_top_k(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (3, [3.0, 4.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0])], "vec_id long, embedding array<float>"
    ).withColumn("v", F.lit(1))
    got = {(r["vec_id"], r["rank"]): (r["neighbour"], r["distance"]) for r in rows(mtree.top_k(df, 2, 1))}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 5.0), (2, 1): (1, 0.0), (2, 2): (3, 5.0), (3, 1): (1, 5.0), (3, 2): (2, 5.0)}
    assert mtree.top_k(df.limit(0)).count() == 0


def test_sentencepiece(docs):
    got = {(r["doc_id"], len(r["ids"]) if r["ids"] is not None else -1): r for r in rows(spiece.encode(docs))}
    assert got[1, -1]["roundtrip"] is None and got[2, 0]["roundtrip"] is True
    assert spiece.encode(docs).count() == len(ROWS) and spiece.encode(docs.limit(0)).count() == 0
    back = {r["text"] for r in rows(spiece.decode(spiece.encode(docs)))}
    assert {t for _, t, *_ in ROWS} == back


def test_toxicity(spark, docs, tables):
    for labels in (None, read(spark, tables, "labels"), read(spark, tables, "labels").limit(0)):
        got = rows(toxicity.score(docs, labels))
        assert len(got) == len(ROWS) and [r["doc_id"] for r in got if r["toxic"]] == [4]
        assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert toxicity.filter_clean(docs).columns == docs.columns and toxicity.filter_clean(docs).count() == len(ROWS) - 1
    assert toxicity.score(docs.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    clash = docs.withColumn("__key", F.lit(7)).withColumn("key1", F.lit(8)).withColumn("row", F.lit("r"))
    kept = neardup.deduplicate(clash)
    assert kept.columns == clash.columns and {(r["__key"], r["key1"], r["row"]) for r in rows(kept)} == {(7, 8, "r")}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows(kept)) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 6)] + [(True, 0)]
    assert [(r["doc_id"], r["duplicate_of"]) for r in rows(neardup.duplicates(docs))] == [(3, 3)]
    assert neardup.duplicates(docs.limit(0)).count() == 0 and neardup.deduplicate(docs.limit(0)).count() == 0
    t = " ".join(f"w{i}" for i in range(60))
    near = [(1, t), (1, t + " more"), (None, t + " x"), (None, t + " y"), ((1 << 63) - 1, t + " z"), (5, "!!!"), (6, " !!! ")]
    df = spark.createDataFrame(near, "doc_id long, text string")
    left, gone = rows(neardup.deduplicate(df)), rows(neardup.duplicates(df))
    assert len(left) + len(gone) == len(near)  # the two agree, of equal and null ids too
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["duplicate_of"]) for r in gone) == [(False, 1, 1), (False, 6, 5), (False, (1 << 63) - 1, 1), (True, 0, 1), (True, 0, 1)]


def test_masked_lm(docs):
    got = rows(maskedlm.score(docs))
    assert len(got) == len(ROWS)
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert all((r["tokens"], r["log_likelihood"], r["mean_log_prob"]) == (0, 0.0, None) for r in empty)
    twice = [r for r in got if r["doc_id"] == 3]
    assert twice[0]["log_likelihood"] == pytest.approx(twice[1]["log_likelihood"], rel=1e-5) and twice[0]["tokens"] == 11 and twice[0]["log_likelihood"] < 0
    assert maskedlm.score(docs.limit(0)).count() == 0


def test_language(docs):
    got = rows(langid.identify(docs))
    assert len(got) == len(ROWS)
    assert all(r["rejected"] and r["lang_pred"] is None for r in got if r["doc_id"] in (1, 2))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 3} == {"en"} and {r["lang_pred"] for r in got if r["doc_id"] == 5} == {"fr"}
    assert all(r["rejected"] for r in rows(langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))))
    assert langid.filter_known(docs).columns == docs.columns and langid.identify(docs.limit(0)).count() == 0


def test_every_stage_keeps_the_columns(spark, docs, tables):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, tables)
            assert out.columns == docs.columns, name
            assert out.count() <= some.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == len(ROWS)


def test_operators_share_a_worker(spark, docs, tables):
    """All operators one after the other in one task each, SentencePiece first: none may spoil what another keeps in the worker."""
    from quillspark.llm import kernel

    kernel._tables.clear(), kernel._powers.clear()
    kernel.powers(10)
    assert len(kernel.Words(["a b"]).hash) == 2
    one, few = docs.coalesce(1), lambda n: read(spark, tables, n).coalesce(1)
    for _ in range(2):
        assert spiece.encode(one).count() == len(ROWS)
        decontam.leaks(one, few("benchmark")).count(), licenses.find(one, windows=True).count(), tokenstore.pack(one).count()
        cotrain.score(one, few("pages"), few("labels")).count(), toxicity.score(one, few("labels")).count(), neardup.duplicates(one).count()
        maskedlm.score(one).count(), langid.identify(one).count()
