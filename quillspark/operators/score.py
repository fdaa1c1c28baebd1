"""Severity of an audit record: class A, B, C or OK, ERR or IMG, the defects found and a score, as one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.audit import COUNTERS

CLASS_ORDER = ("A", "ERR", "B", "C", "IMG", "OK")
_OPTIONAL = {"error": "string", "lang_opf": "string", "lang_db": "string", "fixed_layout": "boolean", "n_images": "int", "n_docs": "int", "encoding_issues": "int"}


@dataclass(frozen=True)
class Finding:
    when: Column
    points: Column
    text: Column


def _with_all(audit: DataFrame) -> DataFrame:
    """The record with every field there is: what is absent counts as 0 or nothing."""
    for name, kind in _OPTIONAL.items():
        if name not in audit.columns:
            audit = audit.withColumn(name, F.lit(None).cast(kind))
    return audit


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def language() -> Column:
    return F.lower(F.coalesce(F.nullif("lang_opf", F.lit("")), F.nullif("lang_db", F.lit("")), F.lit("")))


def is_french() -> Column:
    return language().startswith("fr") | language().isin("", "und")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def findings() -> list[Finding]:
    """The rules in the order in which their defects are listed."""
    fr, chars = is_french(), _n("chars")
    rate = lambda x: F.when(chars > 0, x * 10000.0 / chars).otherwise(F.lit(0.0))
    say = lambda form, *c: F.format_string(form, *c)
    straight, curly = _n("apos_straight"), _n("apos_curly")
    apos = straight + curly
    moji, hyphens, odd = _n("mojibake"), _n("hyphen_residue"), _n("encoding_issues")
    fixed, spaced, bare = (_n(f"punct_{k}") for k in ("nbsp", "space", "none"))
    marks = fixed + spaced + bare
    inner = _n("guil_in_nbsp") + _n("guil_in_space") + _n("guil_in_none")
    loose = _n("guil_in_space") + _n("guil_in_none")
    hyphen = _n("dlg_hyphen")
    dashes = hyphen + _n("dlg_emdash") + _n("dlg_endash")
    lig_bad, lig_good = _n("lig_bad"), _n("lig_good")
    english, guils = _n("dq_straight") + _n("dq_curly"), _n("guil_open") + _n("guil_close")
    dots, dot_char = _n("ellipsis_dots"), _n("ellipsis_char")
    caps_bad, caps_good, soft = _n("caps_bad"), _n("caps_good"), _n("softhyphen")
    detail = F.concat_ws(" + ", F.when(spaced > 0, say("%d sécables", spaced)), F.when(bare > 0, say("%d sans espace", bare)))
    lit = lambda x: F.lit(float(x))
    return [
        Finding(~fr, lit(0), F.concat(F.lit("langue "), language(), F.lit(" — critères FR non appliqués"))),
        Finding(fr & (chars > 30000) & (rate(apos) < 12), lit(120), say("élisions quasi absentes (%.1f apostrophes/10k chars : texte déformé ?)", rate(apos))),
        Finding((moji >= 5) & (rate(moji) > 0.05), 100 + rate(moji) * 10, say("mojibake ×%d (encodage double-décodé)", moji)),
        Finding(odd > 0, lit(80), say("fichiers non-UTF8 ×%d", odd)),
        Finding((hyphens >= 20) & (rate(hyphens) > 0.5), 60 + rate(hyphens) * 5, say("césures résiduelles OCR ×%d (%.1f/10k)", hyphens, rate(hyphens))),
        Finding(fr & (apos > 50) & (_share(straight, apos) > 0.25), 40.0 * straight / F.greatest(apos, F.lit(1)), say("apostrophes droites %d/%d (%.0f %%)", straight, apos, 100 * _share(straight, apos))),
        Finding(
            fr & (marks > 30) & (_share(spaced + bare, marks) > 0.30),
            35.0 * (spaced + bare) / F.greatest(marks, F.lit(1)) + F.when(_share(bare, marks) > 0.5, 15).otherwise(0),
            F.concat(F.lit("insécables ponctuation manquantes : "), detail, say(" / %d", marks)),
        ),
        Finding(fr & (inner > 20) & (_share(loose, inner) > 0.30), lit(10), say("guillemets sans insécable intérieure : %d/%d", loose, inner)),
        Finding(fr & (dashes > 20) & (_share(hyphen, dashes) > 0.30), 30.0 * hyphen / F.greatest(dashes, F.lit(1)), say("dialogues au trait d'union ×%d/%d", hyphen, dashes)),
        Finding(fr & (lig_bad > 3) & (lig_bad > lig_good), lit(15), say("ligatures œ perdues ×%d (vs %d correctes)", lig_bad, lig_good)),
        Finding(fr & (english > 50) & (english > guils), lit(20), say("guillemets anglais dominants ×%d (vs %d français)", english, guils)),
        Finding(fr & (dots > 20) & (dots > dot_char), lit(3), say("« ... » au lieu de « … » ×%d", dots)),
        Finding(fr & (caps_bad > 10) & (caps_bad > caps_good), lit(3), say("capitales non accentuées ×%d (vs %d)", caps_bad, caps_good)),
        Finding(fr & (soft > 200), lit(2), say("soft hyphens ×%d", soft)),
    ]


def classify(audit: DataFrame) -> DataFrame:
    """The audit records with cls, score, defects."""
    rec = _with_all(audit)
    for name in COUNTERS:
        if name not in rec.columns:
            rec = rec.withColumn(name, F.lit(0).cast("long"))
    found = findings()
    total = sum((F.when(f.when, f.points).otherwise(0.0) for f in found[1:]), F.when(found[0].when, found[0].points).otherwise(0.0))
    wrong = F.coalesce(F.col("error"), F.lit("")) != ""
    little = _n("chars") < 2000
    pictures = F.coalesce(F.col("fixed_layout"), F.lit(False)) | (_n("n_images") > _n("n_docs") * 3)
    rec = rec.withColumn("__s", total)
    s = F.col("__s")
    cls = F.when(wrong, "ERR").when(little & pictures, "IMG").when(little, "ERR").when(s >= 60, "A").when(s >= 18, "B").when(s >= 2, "C").otherwise("OK")
    score = F.when(wrong, 999.0).when(little & pictures, 0.0).when(little, 900.0).otherwise(F.round(s, 1))
    defects = (
        F.when(wrong, F.array("error"))
        .when(little & pictures, F.array(F.lit("livre image / fixed-layout — hors périmètre typo texte")))
        .when(little, F.array(F.format_string("texte quasi vide (%d chars) — extraction ou epub suspect", _n("chars"))))
        .otherwise(F.array_compact(F.array(*[F.when(f.when, f.text) for f in found])))
    )
    added = [c for c in rec.columns if c not in audit.columns and c != "__s"]
    return rec.select("*", cls.alias("cls"), score.alias("score"), defects.alias("defects")).drop("__s", *added)


def class_rank(cls: str = "cls") -> Column:
    return sum((F.when(F.col(cls) == c, i).otherwise(0) for i, c in enumerate(CLASS_ORDER)), F.lit(0))


def ranked(classified: DataFrame, *tie: str) -> DataFrame:
    """The records with their place in the order of classes, then falling score, then the columns given.

    One row a book: the global order is that of the report, far smaller than the texts."""
    w = Window.orderBy(class_rank(), F.desc("score"), *tie)
    return classified.withColumn("place", F.row_number().over(w))


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("cls").agg(F.count("*").alias("books"))
