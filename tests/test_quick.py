"""The fast forms of rules and detectors match where the plain ones do."""

import re
import tracemalloc

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.damage import damaged
from quillspark.operators import anomalies, audit, corpus, rules

HARD = [
    "", "l'an d''un 'x' a'b'c", "oeuf boeufs Boeuf choeur CHOEUR ChOeur manoeuvrer Manoeuvré oeoeuf xoeuf oeufx oeuvre_ Oeil OEIL OEil oe", "a... b.... c.. d...e......", "...", "Etat État Etats Etatx Ete Etes Etre Etrex Epee Evenements xEvenement",
    "a ! b\u2009\u2009? c:d e: f» :x ?! x?! …; ’! )»:\n 5? _!", "«a» « b » «» ««c»» x »» «\u00a0d\u00a0»\n»", "e\u0301cole oeuvre\u0301 \u0301oeuf Etat\u0301 \u0301Etat A\u0301 l'\u0301an E\u0301tat", "A la A peu près A demainx A  la", "😀oeuf 😀'a oeuf😀",
]


def test_rules_in_one_pass_are_the_expressions(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in [*HARD, *(t * 2 for t in HARD), None]], "text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(damaged("text").alias("text")))
    for options in ({}, {"style": "nbsp", "a_grave": "wordlist"}):
        t, want = F.col("text"), {}
        for rule in rules.text_rules(**options):
            want[rule.name], t = rule.count(t), rule.apply(t)
        want = rows.select("text", t.alias("fixed"), *[F.coalesce(c, F.lit(-1)).alias(n) for n, c in want.items()])
        got = rules.fix_texts(rows, **options).fillna(-1, [r.name for r in rules.text_rules(**options)])
        assert got.exceptAll(want).collect() == [] and want.exceptAll(got).collect() == []
        assert rows.select("text", rules.corrected("text", **options).alias("fixed")).exceptAll(want.select("text", "fixed")).collect() == []


def test_every_step_begins_with_what_is_searched_for():
    """No step of the text rules begins with a boundary or a look-behind, which would be tried at every character of a text."""
    steps = [p for _, steps in rules.quick_steps("nbsp", "wordlist") for p, _ in steps]
    assert steps and not [p for p in steps if re.match(r"\\b|\(\?<", p)]
    assert T.ODD.search("e\u0301") and not T.ODD.search("« … ’ œ — “é”\u202f")


ODD_TEXTS = [
    "la, le , les, un, une, des , x. le, la", "ab.cd.ef ab.com ab.comx de.fr. cf. la M. la … la .. la", "M Du M Éa xM Du M du", "abc- def- ghi xbc- de_ Abc- de é- ab ab- éa", "le le le le oui oui la la. le lea ale le", "... .... ..... a ,\n b . c", ".,.. ,. «« »",
    "éla, le x́ab- cd́ ab- cd́ le lé ́M Du ab.coḿ lé, a", "😀la, le ab- cd😀 le le", ", Il, Elle. la", "", "lame, a votre , b cette, c xcette, d",
]


def test_detectors_are_tried_where_their_patterns_match(sf_dir):
    """Also in chains of more than four determiners, each of which takes the first letter of the next."""
    import duckdb

    from quillspark.functions.damage import damaged_sql

    texts = [*ODD_TEXTS, *(t * 2 for t in ODD_TEXTS), *(r[0] for r in duckdb.sql(f"select {damaged_sql()} from '{sf_dir}/documents.parquet'").fetchall())]
    for t in texts:
        odd = T.ODD.search(t) is not None
        for kind, pattern in anomalies.PATTERNS.items():
            compiled = lambda p: anomalies._compiled(p, odd)
            assert [m.span() for m in anomalies._matches(kind, t, compiled)] == [m.span() for m in compiled(pattern).finditer(t)], (kind, t)
    assert sum(1 for _ in anomalies._places("det_virgule", "la, " * 9 + "x")) == 5


def test_book_counts_are_the_expressions_and_only_the_types_asked_for(spark):
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate([*ODD_TEXTS, None])] + [(9, None)], "b int, text string")
    native = docs.groupBy("b").agg(*[F.sum(c).alias(k) for k, c in anomalies.counts("text").items()]).unpivot(["b"], [*anomalies.PATTERNS, "guillemet_desequilibre"], "type", "n")
    got = anomalies.count_by_book(docs, ["b"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, native.collect()), key=repr)
    one = anomalies.count_by_book(docs, ["b"], types=["mot_double"])
    assert {r["type"] for r in one.collect()} == {"mot_double"} and "cesure" not in one._jdf.queryExecution().toString()


def test_first_records_and_totals_are_what_the_cap_leaves(spark):
    rows = [(f"b{i % 2}", i if i else None, f"{t} motrare{chr(97 + i % 26)}{chr(97 + i // 26)} fin") for i, t in enumerate(ODD_TEXTS * 4)]
    docs, words = spark.createDataFrame(rows, "b string, d int, text string").repartition(3), spark.createDataFrame([("fin",), ("abcdef",)], "word string")
    unknown = anomalies.unknown_words(docs, ["b"], words, first="d")
    found = anomalies.records(docs, ["b", "d"], unknown=unknown, lexicon=words, book=["b"])
    for cap in (1, 3, 400):
        want = anomalies.capped(found, ["b"], ["d"], cap)
        for shared in (200_000, 0):
            got = anomalies.first_records(docs, ["b"], "d", unknown=unknown, lexicon=words, per_type=cap, shared_words=shared)
            assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())), cap
        kept = want.groupBy("b", "type").agg(F.count("*").alias("kept"))
        want = anomalies.statistics(found, ["b"]).join(kept, ["b", "type"]).select("b", "type", "n", "kept")
        assert sorted(map(tuple, anomalies.totals(docs, ["b"], unknown=unknown, per_type=cap).select("b", "type", "n", "kept").collect())) == sorted(map(tuple, want.collect()))


def test_candidates_carry_no_text_beside_them(spark):
    """Each candidate once carried its whole text and all its parts, so that many in a text cost their square."""
    texts = ["A la A b" * 3, " \u2003A la \u00a0", "xA la Á la A\u0301 la \u0301A la _A la A  la A É", "", None, "A la " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = corpus.candidates(docs, ["id"])
    want = [(0, 0, "", "A la A bA la A bA la A b"), (0, 1, "A la ", "A bA la A bA la A b"), (0, 2, "A la A bA la ", "A bA la A b"), (0, 3, "A la A bA la A bA la ", "A b"), (1, 0, "", "A la")]
    assert sorted(map(tuple, found.filter("id < 5").collect())) == want
    many = found.filter("id = 5").collect()
    assert len(many) == 3000 and many[2999]["idx"] == 2999 and len(many[2999]["avant"]) == 60
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_python_holds_few_texts_of_a_batch_at_a_time():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["x" * 1000] * 10_000)], ["t"])
    seen = T.rows(batch)
    tracemalloc.start()
    assert sum(len(t) for (t,) in seen) == 10_000_000
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    assert audit.counted.func(batch.column(0)).field("chars").to_pylist() == [1000] * 10_000
    assert tracemalloc.get_traced_memory()[1] - before < 70_000_000
    tracemalloc.stop()
