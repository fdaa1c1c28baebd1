"""Counters, classes at their thresholds, anomalies, projections."""

import re

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.damage import damaged
from quillspark.operators import anomalies, audit, score


def counters(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in audit.text_counters("t").items()]).orderBy("i").collect()]


def test_text_counters(spark):
    a, b, c = counters(spark, "l'an « oui » «non» ! x? 10:30 la : a:b ...", "coeur Oeuvre sœur Etat État A la À ex- em", "dÃ©jà �")
    assert a["apos_straight"] == 1 and a["guil_open"] == a["guil_close"] == 2 and a["ellipsis_dots"] == 1
    assert (a["guil_in_space"], a["guil_in_none"]) == (2, 2)
    assert a["punct_space"] == 2 and a["punct_none"] == 2
    assert (b["lig_bad"], b["lig_good"], b["caps_bad"], b["caps_good"], b["hyphen_residue"]) == (2, 1, 2, 2, 1)
    assert c["mojibake"] == 2


def test_one_pass_counts_what_the_expressions_count(spark, sf_dir):
    hard = [
        "", "a- b- c- d- e", "«««x»»»", "« « x » »", "x»»", "«", "»", "....", "... ...", "a:1 a:b a: b) :", "É ? à ! ? :", "Ã©Â«Â\u00a0Å“â€™â€œ\ufffd", "MANOEUVRES oeillets Coeur coEUR œil Œuvres manœuvrer",
        "Ecole ECOLE Eclairage école A la A peu près A peu pres A  la À Àh Etre Etres Énormes Étatique", "A", "A la", "peu près A", "e\u0301cole E\u0301tat oeuvre\u0301", "\n\n«\n»", "😀 « 😀»", "a\u2009!b\u202f?c\u00a0:",
    ]
    rows = [(t,) for t in hard] + [(t * 3,) for t in hard] + [("x" * 400_000 + "! «a»",)]
    df = spark.createDataFrame(rows, "text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(damaged("text").alias("text")))
    native = df.select("text", *[c.alias(n) for n, c in audit.text_counters("text").items()])
    one = df.select("text", audit.counted(F.col("text")).alias("c")).select("text", "c.*")
    assert native.exceptAll(one).collect() == [] and one.exceptAll(native).collect() == []


def test_dialogues(spark):
    html = "<p>— a</p><p><i>&#8212; b</i></p><p>&ndash; c</p><p> - d</p><p></p><p>x - y</p>"
    df = spark.createDataFrame([(html,)], "h string")
    assert tuple(df.select(*audit.dialogue_counters("h").values()).first()) == (2, 1, 1)


def test_text_without_head_and_style_but_with_script(spark):
    df = spark.createDataFrame([("<html><head><title>t</title></head><body><style>s</style><script>j</script><p>a&amp;b</p></body>",)], "h string")
    r = df.select(T.text_audit("h"), T.text_anomaly("h"), T.text_license("h"), T.text_sample("h")).first()
    assert tuple(r) == ("ja&b", "a&b", " ".join(["<x>"]).replace("<x>", re.sub("<[^>]+>", " ", "<html><body><style>s</style><script>j</script><p>a&amp;b</p></body>")), "ja&b")


BASE = {"chars": 50_000, "apos_curly": 500}


def classes(spark, *records):
    fields = sorted({k for r in records for k in r} | {"chars"})
    kinds = {"error": "string", "lang_db": "string", "fixed_layout": "boolean"}
    schema = "i int, " + ", ".join(f"{f} {kinds.get(f, 'long')}" for f in fields)
    df = spark.createDataFrame([(i, *(r.get(f) for f in fields)) for i, r in enumerate(records)], schema)
    return [(r["cls"], r["score"], r["defects"]) for r in score.classify(df).orderBy("i").collect()]


def test_classes_and_thresholds(spark):
    got = classes(
        spark,
        BASE,
        {"chars": 100},
        {"chars": 100, "fixed_layout": True},
        BASE | {"error": "epub_not_found"},
        BASE | {"apos_curly": 59},
        BASE | {"mojibake": 5},
        BASE | {"encoding_issues": 1},
        BASE | {"punct_nbsp": 5, "punct_space": 26},
        BASE | {"punct_nbsp": 5, "punct_space": 25},
        BASE | {"ellipsis_dots": 21},
        BASE | {"lang_db": "en", "mojibake": 5},
        BASE | {"dlg_hyphen": 21},
    )
    assert [g[0] for g in got] == ["OK", "ERR", "IMG", "ERR", "A", "A", "A", "B", "OK", "C", "A", "B"]
    assert [g[1] for g in got] == [0.0, 900.0, 0.0, 999.0, 120.0, 110.0, 80.0, 29.4, 0.0, 3.0, 110.0, 30.0]
    assert got[10][2] == ["langue en — critères FR non appliqués", "mojibake ×5 (encodage double-décodé)"]
    assert got[7][2] == ["insécables ponctuation manquantes : 26 sécables / 31"]


def test_rank(spark):
    df = spark.createDataFrame([("x", "OK", 0.0), ("y", "A", 61.0), ("z", "A", 90.0), ("e", "ERR", 999.0)], "id string, cls string, score double")
    assert [r["id"] for r in score.ranked(df, "id").orderBy("place").collect()] == ["z", "y", "e", "x"]


SAMPLES = {
    "min_apres_point": ("fin. et puis M. le … et. p. x", 2),
    "maj_apres_virgule": ("oui, Elle vint, Les gens, Paul", 2),
    "point_colle": ("mot.suite site.fr ab.cd", 2),
    "det_virgule": ("un, mot la , chose le mot", 2),
    "abrev_m": ("M Durand et M. Paul", 1),
    "mot_double": ("le le nous nous mot mot mot", 2),
    "quatre_points": ("a.... b... c.....", 2),
    "espace_avant_point": ("mot , et mot .\nfin", 2),
    "virgule_point": ("a,. b., c.. d,,", 3),
    "cesure_residuelle": ("ex- emple et - non", 1),
    "guillemet_desequilibre": ("« oui", 1),
}


def test_each_detector(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in SAMPLES.items()], "k string, text string")
    native = {r["k"]: r for r in df.select("k", *[c.alias(n) for n, c in anomalies.counts("text").items()]).collect()}
    for kind, (t, n) in SAMPLES.items():
        records = [r for r in anomalies.find(t) if r[0] == kind]
        assert len(records) == native[kind][kind] == n, (kind, records, native[kind][kind])


def test_counts_equal_records_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", damaged("text").alias("text"))
    native = {r["type"]: r["n"] for r in anomalies.count_by_book(docs.withColumn("b", F.lit(1)), ["b"]).collect() if r["n"]}
    found = anomalies.records(docs, ["doc_id"])
    assert {r["type"]: r["count"] for r in found.groupBy("type").count().collect()} == native


def test_unknown_words_lexicon_and_cap(spark):
    docs = spark.createDataFrame([("b", 1, "Paul dit l'iran zorglub. Zorglub mot mot mot un- iran un- vu"), ("b", 2, None)], "book string, doc int, text string")
    lexicon = spark.createDataFrame([("iran",), ("dit",), ("unvu",)], "word string")
    words = anomalies.unknown_words(docs, ["book"], lexicon)
    assert sorted(r["word"] for r in words.collect()) == ["zorglub"]
    found = anomalies.records(docs, ["book", "doc"], unknown=words, lexicon=lexicon, book=["book"])
    rows = found.orderBy("detector", "pos").collect()
    assert [r["extrait"] for r in rows if r["type"] == "mot_inconnu"] == ["zorglub", "Zorglub"]
    assert [(r["extrait"], r["suggestion"]) for r in rows if r["type"] == "cesure_residuelle"] == [("un- iran", None), ("un- vu", "unvu")]
    assert anomalies.capped(found, ["book"], ["doc"], 1).filter("type = 'mot_inconnu'").count() == 1
    assert {r["type"]: r["n"] for r in anomalies.statistics(found, ["book"]).collect()}["mot_inconnu"] == 2
