"""Applies reviewed corrections under constraints: size bounds, uniqueness, a budget for each book, an unchanged sequence of tags.

The bounds and the budget are native expressions over all corrections.  A
correction sees the effect of those before it in the same document, so the
edits of one document are a fold: its corrections are gathered in order beside
it, and one Arrow pass edits the documents that have any.
"""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as T

MIN_LENGTH = 8
CORRECTION = "doc string, chercher string, remplacer string, raison string, source string, ord long"
OUTCOME = "ord long, chercher string, remplacer string, raison string, source string, status string, reason string, before string, actual string, after string, seq int"
AROUND = 55
_SPACES = str.maketrans({T.NBSP: " ", T.NNBSP: " ", T.THIN: " "})
_TAG = re.compile(T.TAG)


def norm_spaces(t: T.Text) -> Column:
    return F.translate(T.col(t), T.NBSP + T.NNBSP + T.THIN, "   ")


# --- bounds --------------------------------------------------------------------------------------------


def edit_distance(a: T.Text, b: T.Text, cap: int = 40) -> Column:
    """Levenshtein distance, cap + 1 beyond the cap."""
    d = F.levenshtein(T.col(a), T.col(b), cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def usable(corrections: DataFrame) -> DataFrame:
    """Corrections that ask for a change."""
    return corrections.filter((F.col("chercher") != "") & F.col("remplacer").isNotNull() & (F.col("chercher") != F.col("remplacer")))


def bounded(corrections: DataFrame, max_edit: int = 12, max_word_delta: int = 2) -> DataFrame:
    """corrections with refusal: why their size alone rules them out, or null."""
    a, b = F.col("chercher"), F.col("remplacer")
    words = F.abs(T.words(b) - T.words(a))
    edit = edit_distance(a, b)
    longer = F.abs(F.length(b) - F.length(a))
    removal = (F.instr(norm_spaces(a), norm_spaces(b)) > 0) & (F.length(b) < F.length(a))
    beyond = (edit > F.when(removal, 30).otherwise(max_edit)) | (words > F.when(removal, 6).otherwise(max_word_delta)) | (longer > 60)
    return corrections.withColumn(
        "refusal",
        F.when(F.length(a) < MIN_LENGTH, F.lit("motif trop court (<8 chars), ambigu")).when(beyond, F.format_string("au-delà des bornes (édition %d, mots Δ%d)", edit, words)),
    )


def budgets(docs: DataFrame, corrections: DataFrame, book: list[str], markup: str = "html", percent: float = 0.2) -> DataFrame:
    """words, budget, asked, within for each book; words are those of the markup, tags and all."""
    words = docs.groupBy(*book).agg(F.sum(T.words(F.coalesce(F.col(markup), F.lit("")))).alias("words"))
    asked = usable(corrections).groupBy(*book).agg(F.count("*").alias("asked"))
    budget = F.greatest(F.lit(25).cast("long"), F.floor(F.col("words") * percent / 100))
    return words.join(asked, book, "left").select(*book, "words", budget.alias("budget"), F.coalesce("asked", F.lit(0).cast("long")).alias("asked")).withColumn("within", F.col("asked") <= F.col("budget"))


# --- edits -----------------------------------------------------------------------------------------------


def flat(s: str) -> str:
    return s.translate(_SPACES)


def places(t: str, wanted: str) -> list[int]:
    """All places, overlapping ones too."""
    out, at = [], t.find(wanted)
    while at >= 0:
        out.append(at)
        at = t.find(wanted, at + 1)
    return out


def spliced(actual: str, wanted: str, by: str) -> str:
    """The replacement, with the actual characters wherever wanted and replacement agree but for the kind of space."""
    ops = difflib.SequenceMatcher(None, flat(wanted), flat(by), autojunk=False).get_opcodes()
    return "".join(actual[i:j] if op == "equal" else by[k:n] for op, i, j, k, n in ops)


@dataclass
class Edit:
    segment: int
    at: int
    text: str


def locate(texts: dict[int, str], wanted: str, by: str) -> Edit | str:
    """The one place where a correction fits and the segment's text after it, or why there is none."""
    exact = sum(t.count(wanted) for t in texts.values())
    if exact > 1:
        return f"motif non unique ({exact} occurrences)"
    if exact == 1:
        i = next(i for i, t in texts.items() if wanted in t)
        return Edit(i, texts[i].find(wanted), texts[i].replace(wanted, by, 1))
    near = [(i, p) for i, t in texts.items() for p in places(flat(t), flat(wanted))]
    if not near:
        return "motif introuvable dans les segments texte"
    if len(near) > 1:
        return f"motif non unique avec tolérance espaces ({len(near)})"
    (i, p), t = near[0], texts[near[0][0]]
    q = p + len(wanted)
    return Edit(i, p, t[:p] + spliced(t[p:q], wanted, by) + t[q:])


def edit_document(markup: str, corrections: list[dict]) -> tuple[str, list[dict]]:
    """The markup after its corrections in order, and an outcome for each."""
    segs = T.split_segments(markup)
    texts = {i: t for i, (t, kind, _) in enumerate(segs) if kind == T.PLAIN}
    out = []
    for c in corrections:
        found = c["refusal"] or locate(texts, c["chercher"], c["remplacer"])
        row = {k: c[k] for k in ("ord", "chercher", "remplacer", "raison", "source")} | {"reason": None, "before": None, "actual": None, "after": None}
        if isinstance(found, str):
            out.append(row | {"status": "rejected", "reason": found})
            continue
        old, end = texts[found.segment], found.at + len(c["chercher"])
        out.append(row | {"status": "applied", "before": old[max(0, found.at - AROUND) : found.at], "actual": old[found.at : end], "after": old[end : end + AROUND]})
        texts[found.segment] = found.text
    new = "".join(html.escape(texts[i], quote=False) if i in texts else t for i, (t, _, _) in enumerate(segs))
    if _TAG.findall(new) != _TAG.findall(markup):
        refused = [o for o in out if o["status"] == "rejected"]
        every = [{k: c[k] for k in ("ord", "chercher", "remplacer", "raison", "source")} | {"status": "rejected", "reason": "doc entier rejeté (balises)", "before": None, "actual": None, "after": None} for c in corrections]
        return markup, refused + every
    return new, out


@dataclass
class Applied:
    """docs: all columns and fixed; outcomes: the key, and a row for each thing decided; budgets: see budgets()."""

    docs: DataFrame
    outcomes: DataFrame
    budgets: DataFrame


def apply_corrections(
    docs: DataFrame, corrections: DataFrame, book: list[str], doc: str = "doc", markup: str = "html", max_edit: int = 12, max_word_delta: int = 2, percent: float = 0.2
) -> Applied:
    """Corrections (the columns of book, doc, chercher, remplacer, raison, source, ord) applied to docs.

    A book over its budget is left as it is, its corrections rejected as such; corrections
    of documents that don't exist have no outcome (see orphans)."""
    key = [*book, doc]
    gate = budgets(docs, corrections, book, markup, percent)
    todo = bounded(usable(corrections), max_edit, max_word_delta).join(gate.select(*book, "budget", "asked", "within"), book)
    over = ~F.col("within")
    todo = todo.withColumn("refusal", F.when(over, F.format_string("budget dépassé (%d > %d)", "asked", "budget")).otherwise(F.col("refusal")))
    fields = ["ord", "chercher", "remplacer", "raison", "source", "refusal"]
    lists = todo.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__c"))
    joined = docs.join(lists, key, "left")
    with_any = joined.filter("__c is not null").select(*key, markup, "__c")
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "fixed string", f"outcomes array<struct<{', '.join(':'.join(x.split()) for x in OUTCOME.split(', '))}>>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fixed, outcomes = [], []
            for m, c in zip(f[markup], f["__c"]):
                new, out = edit_document(m or "", [dict(x) if isinstance(x, dict) else x.asDict() for x in c])
                fixed.append(new)
                outcomes.append([o | {"seq": i} for i, o in enumerate(out)])
            yield f[key].assign(fixed=fixed, outcomes=outcomes)

    edited = with_any.mapInPandas(run, schema)
    result = docs.join(edited.select(*key, "fixed"), key, "left").withColumn("fixed", F.coalesce("fixed", markup))
    return Applied(result, edited.select(*key, F.inline("outcomes")), gate)


def orphans(corrections: DataFrame, docs: DataFrame, book: list[str], doc: str = "doc") -> DataFrame:
    """Corrections whose document doesn't exist: neither applied nor rejected."""
    return usable(corrections).join(docs.select(*book, doc), [*book, doc], "left_anti")


@F.pandas_udf(StringType())
def inline_diff(actual: pd.Series, wanted: pd.Series, by: pd.Series) -> pd.Series:
    """The change as HTML: what went in <del>, what came in <ins>."""

    def one(a, w, b):
        if a is None or w is None or b is None:
            return None
        esc = lambda s: html.escape(s, quote=False)
        out = []
        for op, i, j, k, n in difflib.SequenceMatcher(None, flat(w), flat(b), autojunk=False).get_opcodes():
            if op == "equal":
                out.append(esc(a[i:j]))
            else:
                out += [f"<del>{esc(a[i:j])}</del>"] * (j > i) + [f"<ins>{esc(b[k:n])}</ins>"] * (n > k)
        return "".join(out)

    return pd.Series([one(*x) for x in zip(actual, wanted, by)], dtype=object)
