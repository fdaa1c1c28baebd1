"""Reversible typographic rules R1 to R7 as column expressions, the guard that proves a change harmless, and both applied to documents."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

BREAKING = f"[ {T.THIN}]"
WIDE = f"[ {T.NBSP}{T.NNBSP}{T.THIN}]"
BLANK = f"[{T.SPACE}]"
SPACES = {"fine": T.NNBSP, "nbsp": T.NBSP}

_OE_HEAD = r"(?U)\b([cC]h?|[mM]an|[bBmMnNsSvV]|)"
_OE_TAIL = r"(illades?|illets?|ils?|sophages?|uds?|ufs?|urs?|uvr\w*|ux|u)\b"
OE_ANY, OE_LOWER, OE_UPPER = (f"{_OE_HEAD}{m}{_OE_TAIL}" for m in ("(?:oe|OE|Oe)", "oe", "O[eE]"))

#: what follows the initial E of capitalised words that want an accent; then those that want more than that
_ACUTE = "clairs? coles? coute(?:z)? glises? gypte normes? poque quipe tages? taient tais tait tang tant tats? teins ternel ternelle tions toiles? tranges? trangement videmment vidence"
ACUTE = _ACUTE.split()
CAPITALS = [
    (rf"(?U)\bE(?=(?:{'|'.join(ACUTE)})\b)", "É"),
    (r"(?U)\bE(?=t(?:re|es)\b)", "Ê"),
    (r"(?U)\bEte\b", "Été"),
    (r"(?U)\bEpee\b", "Épée"),
    (r"(?U)\bEvenement(?=s?\b)", "Événement"),
]
A_BEFORE = (
    "bientôt cause ce~point ces cet cette chaque cheval côté demain droite gauche la le les midi minuit moitié mon~avis "
    "nouveau partir peine peu~près pied présent qui quoi table terre travers votre vrai~dire"
)
A_WORDLIST = rf"(?U)\bA(?= (?:{A_BEFORE.replace('~', '§').replace(' ', '|').replace('§', ' ')})\b)"
A_CANDIDATE = f"(?U)\\bA(?= [{T.LOWER}])"
BROKEN = "Ã[\u00a0-ÿ]|â€[™œ\u009d\u201c\u201d]|Å[\u201c\u2019]|Â[«»\u00a0]|\ufffd"


# --- rules: text to text, and how often they fire ---------------------------------------


@dataclass(frozen=True)
class Rule:
    """Replacements made one after the other; the number of matches of each, just before it is made, is what it counts."""

    name: str
    steps: tuple[tuple[str, str], ...]

    def apply(self, t: Column) -> Column:
        for pattern, by in self.steps:
            t = T.sub(t, pattern, by)
        return t

    def count(self, t: Column) -> Column:
        n = F.lit(0).cast("long")
        for pattern, by in self.steps:
            n = n + T.count_re(t, pattern)
            t = T.sub(t, pattern, by)
        return n


APOSTROPHES = Rule("R1_apostrophes", ((f"(?<=[{T.LETTER}])'(?=[{T.LETTER}])", "’"),))
LIGATURES = Rule("R2_ligatures", ((OE_LOWER, "$1œ$2"), (OE_UPPER, "$1Œ$2")))
DIALOGUES = Rule("R3_dialogues", ((f"(?U)^({BLANK}*)-{WIDE}+", f"$1—{T.NBSP}"),))
ELLIPSIS = Rule("R5_ellipsis", ((r"(?<!\.)\.{3}(?!\.)", "…"),))


def spacing(style: str = "fine") -> Rule:
    """R4: spaces that don't break before high punctuation and inside guillemets."""
    sp = SPACES[style]
    return Rule(
        "R4_insecables",
        (
            (f"{BREAKING}+([!?;:»])", f"{sp}$1"),
            (f"(?<=[{T.LETTER}0-9)»…’])(?=[!?;])", sp),
            (f"(?U)(?<=[{T.LETTER})»])(?=:{BLANK})", sp),
            (f"«{BREAKING}+", f"«{sp}"),
            (f"(?U)«(?=[^{T.SPACE}])", f"«{sp}"),
            (f"(?U)(?<=[^{T.SPACE}«])(?=»)", sp),
        ),
    )


def capitals(wordlist: bool = False) -> Rule:
    return Rule("R6_capitales", (*CAPITALS, (A_WORDLIST, "À")) if wordlist else tuple(CAPITALS))


def text_rules(style: str = "fine", a_grave: str = "off") -> list[Rule]:
    """R1, R2, R5, R6, R4, in the order in which they are applied to a text."""
    return [APOSTROPHES, LIGATURES, ELLIPSIS, capitals(a_grave == "wordlist"), spacing(style)]


def corrected(text: T.Text, style: str = "fine", a_grave: str = "off") -> Column:
    return _one_pass(style, a_grave)(T.col(text))["fixed"]


# --- R7 and the approved À --------------------------------------------------------------------


def repair(text: str) -> str:
    """Undoes UTF-8 that was read as Windows-1252 or Latin-1, if that leaves nothing suspect."""
    broken = re.compile(BROKEN)
    if not broken.search(text):
        return text
    for charset in ("cp1252", "latin-1"):
        try:
            better = text.encode(charset).decode("utf-8")
        except UnicodeError:
            continue
        if not broken.search(better):
            return better
    return text


# --- the guard -------------------------------------------------------------------------------

_FOLD_FROM = "’—–" + T.NBSP + T.NNBSP + T.THIN + "ÉÈÊÀ"
_FOLD_TO = "'--" + "   " + "EEEA"


def normal_form(text: T.Text, fold_oe: bool = False) -> Column:
    """What the rules must leave as it is: the text with everything that they may change made equal.

    fold_oe also makes "Oe" equal to "OE"; without it a title-case "Oe" that became "Œ" counts as a change."""
    t = F.translate(T.col(text), _FOLD_FROM, _FOLD_TO)
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("…", "...")):
        t = F.replace(t, F.lit(a), F.lit(b))
    if fold_oe:
        t = F.replace(t, F.lit("Oe"), F.lit("OE"))
    t = T.sub(T.sub(t, "[ \t]*([!?;:»])", "$1"), "«[ \t]*", "«")
    return T.strip(T.sub(t, f"(?U){BLANK}+", " "))


def tags(markup: T.Text) -> Column:
    return F.regexp_extract_all(T.col(markup), F.lit(T.TAG), F.lit(0))


def validation(original: T.Text, fixed: T.Text, repaired_text: T.Text | None = None, fold_oe: bool = False) -> Column:
    """null if the change is harmless, else what is wrong with it; the text isn't compared where a repair changed it."""
    a, b = T.col(original), T.col(fixed)
    ta, tb = tags(a), tags(b)
    na, nb = normal_form(T.text_check(a), fold_oe), normal_form(T.text_check(b), fold_oe)
    skip = F.lit(False) if repaired_text is None else T.col(repaired_text)
    return F.when(ta != tb, F.format_string("séquence de balises modifiée (longueur %d → %d)", F.size(ta), F.size(tb))).when(
        ~skip & (na != nb), F.format_string("texte modifié hors règles (longueur %d → %d)", F.length(na), F.length(nb))
    )


# --- documents -----------------------------------------------------------------------------------

COUNTED = ["R1_apostrophes", "R2_ligatures", "R3_dialogues", "R4_insecables", "R5_ellipsis", "R6_a_grave_llm", "R6_capitales", "R7_mojibake"]


OUTCOME = "fixed string, status string, problem string, " + ", ".join(f"{n} long" for n in COUNTED)
_A = re.compile(f"\\bA(?= [{T.LOWER}])")
_UNSEEN = re.compile(r"(?is)<(script|style)\b.*?</\1>")
_TAG = re.compile(T.TAG)
_FOLD = str.maketrans(_FOLD_FROM, _FOLD_TO)
_NORMAL = [(re.compile("[ \t]*([!?;:»])"), r"\1"), (re.compile("«[ \t]*"), "«"), (re.compile(r"\s+"), " ")]


def _compiled(rule: Rule) -> list[tuple[re.Pattern, str]]:
    """The rule's steps for Python, whose classes are Unicode ones by default."""
    return [(re.compile(p.replace("(?U)", "")), re.sub(r"\$(\d)", r"\\\1", by)) for p, by in rule.steps]


def _led(literal: str) -> str:
    """What may stand before the oe of a ligature, as look-behinds after it."""
    return f"{literal}(?:(?<=\\b{literal})|(?<=\\b[bBcCmMnNsSvV]{literal})|(?<=\\b[cC]h{literal})|(?<=\\b[mM]an{literal}))"


def quick_steps(style: str = "fine", a_grave: str = "off") -> list[tuple[str, list[tuple[str, str]]]]:
    """The steps of text_rules for Python, each with its rarest character first, which is searched for fast; what stands before it is a look-behind.

    They match at the same places as often; a test compares both forms."""
    sp = SPACES[style]
    grave = [(A_WORDLIST.replace("(?U)", "").replace(r"\bA", r"A(?<=\bA)", 1), "À")] if a_grave == "wordlist" else []
    return [
        ("R1_apostrophes", [(f"'(?<=[{T.LETTER}]')(?=[{T.LETTER}])", "’")]),
        ("R2_ligatures", [(_led("oe") + _OE_TAIL, r"œ\1"), (_led("O[eE]") + _OE_TAIL, r"Œ\1")]),
        ("R5_ellipsis", [(r"\.\.\.(?<!\.{4})(?!\.)", "…")]),
        (
            "R6_capitales",
            [
                (rf"E(?<=\bE)(?=(?:{'|'.join(ACUTE)})\b)", "É"), (r"E(?<=\bE)(?=t(?:re|es)\b)", "Ê"), (r"Ete(?<=\bEte)\b", "Été"), (r"Epee(?<=\bEpee)\b", "Épée"),
                (r"Evenement(?<=\bEvenement)(?=s?\b)", "Événement"), *grave,
            ],
        ),
        (
            "R4_insecables",
            [
                (f"{BREAKING}+([!?;:»])", rf"{sp}\1"), (f"([!?;])(?<=[{T.LETTER}0-9)»…’][!?;])", rf"{sp}\1"), (f":(?<=[{T.LETTER})»]:)(?={BLANK})", f"{sp}:"),
                (f"«{BREAKING}+", f"«{sp}"), (f"«(?=[^{T.SPACE}])", f"«{sp}"), (f"»(?<=[^{T.SPACE}«]»)", f"{sp}»"),
            ],
        ),
    ]


class Corrector:
    """text_rules on one text at a time: (text, how often each rule fired)."""

    def __init__(self, style: str, a_grave: str) -> None:
        self.options = style, a_grave
        self.forms: dict[bool, list[list[tuple[re.Pattern, str]]]] = {}

    def __getstate__(self) -> dict:
        return {"options": self.options, "forms": {}}

    def __call__(self, t: str) -> tuple:
        odd = T.ODD.search(t) is not None
        if odd not in self.forms:
            self.forms[odd] = [[(re.compile(T.with_marks(p) if odd else p), by) for p, by in steps] for _, steps in quick_steps(*self.options)]
        n = []
        for steps in self.forms[odd]:
            fired = 0
            for pattern, by in steps:
                t, k = pattern.subn(by, t)
                fired += k
            n.append(fired)
        return t, *n


def _one_pass(style: str, a_grave: str):
    """The rules as an Arrow function: the text after them and the count of each; null stays null."""
    names, correct = ["fixed", *(r.name for r in text_rules(style, a_grave))], Corrector(style, a_grave)

    kinds = pa.struct([(n, pa.int64() if n != "fixed" else pa.string()) for n in names])

    @F.arrow_udf("fixed string, " + ", ".join(f"{n} long" for n in names[1:]))
    def run(texts: pa.Array) -> pa.Array:
        done = [pa.array([dict(zip(names, correct(t) if t is not None else (None,) * len(names))) for t in texts.slice(i, 256).to_pylist()], kinds) for i in range(0, len(texts), 256)]
        return pa.concat_arrays(done) if done else pa.array([], kinds)

    return run


def _normal(markup: str, fold_oe: bool) -> str:
    t = html.unescape(_TAG.sub("\0", _UNSEEN.sub("", markup))).translate(_FOLD)
    t = t.replace("œ", "oe").replace("Œ", "OE").replace("…", "...")
    if fold_oe:
        t = t.replace("Oe", "OE")
    for pattern, by in _NORMAL:
        t = pattern.sub(by, t)
    return t.strip()


@dataclass
class Fixer:
    """All rules on one document at a time, each pattern run once over each plain segment."""

    style: str
    a_grave: str
    mojibake: bool
    fold_oe: bool

    def __post_init__(self) -> None:
        self.rules = [(r.name, _compiled(r)) for r in text_rules(self.style, self.a_grave)]
        ((self.dash, self.dash_by),) = _compiled(DIALOGUES)

    def fix(self, markup: str | None, approved: list[int] | None = None) -> tuple:
        """(fixed, status, problem, the counts of COUNTED)."""
        n = dict.fromkeys(COUNTED, 0)
        if markup is None:
            return None, None, None, *n.values()
        chosen, seen = frozenset(() if approved is None else approved), 0
        out = []

        def grave(_: re.Match) -> str:
            nonlocal seen
            seen += 1
            return "À" if seen - 1 in chosen else "A"

        for t, kind, para in T.split_segments(markup):
            if kind != T.PLAIN:
                out.append(t)
                continue
            if para:
                t, k = self.dash.subn(self.dash_by, t)
                n["R3_dialogues"] += k
            if chosen:
                t = _A.sub(grave, t)
            if self.mojibake:
                better = repair(t)
                n["R7_mojibake"] += better != t
                t = better
            for name, steps in self.rules:
                for pattern, by in steps:
                    t, k = pattern.subn(by, t)
                    n[name] += k
            out.append(html.escape(t, quote=False))
        n["R6_a_grave_llm"] = sum(0 <= i < seen for i in chosen)
        new = "".join(out)
        if new == markup:
            return markup, "unchanged", None, *n.values()
        problem = self.problem(markup, new, n["R7_mojibake"] > 0)
        return (new, "changed", None, *n.values()) if problem is None else (markup, "rejected", problem, *[0] * len(n))

    def problem(self, old: str, new: str, repaired: bool) -> str | None:
        """What is wrong with a change; the text isn't compared where a repair changed it."""
        a, b = _TAG.findall(old), _TAG.findall(new)
        if a != b:
            return f"séquence de balises modifiée (longueur {len(a)} → {len(b)})"
        a, b = ("", "") if repaired else (_normal(old, self.fold_oe), _normal(new, self.fold_oe))
        return None if a == b else f"texte modifié hors règles (longueur {len(a)} → {len(b)})"


def fix_documents(
    docs: DataFrame, markup: str = "html", style: str = "fine", a_grave: str = "off", mojibake: bool = False, decisions: DataFrame | None = None, key: list[str] | None = None, fold_oe: bool = False
) -> DataFrame:
    """docs with fixed (the markup after all rules that passed the guard), status (unchanged, changed, rejected), problem, and a count for each rule.

    decisions: the columns of key and idx, the approved isolated A of each document.
    A null document stays null, with a null status.  Columns of docs that are named like one of these are replaced.
    Each document goes through Python once, in Arrow batches: its segments need a state, and native functions over
    arrays of segments would run each pattern three times without generated code."""
    fixer = Fixer(style, a_grave, mojibake, fold_oe)
    df, carried = docs, [c for c in docs.columns if c not in ("fixed", "status", "problem", *COUNTED)]
    idx = F.lit(None).cast("array<int>")
    if decisions is not None:
        chosen = decisions.groupBy(*key).agg(F.sort_array(F.collect_set(F.col("idx").cast("int"))).alias("__idx"))
        df, idx = df.join(chosen, key, "left"), F.col("__idx")

    @F.pandas_udf(OUTCOME)
    def fixed(texts: pd.Series, approved: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fixer.fix(t, a) for t, a in zip(texts, approved)], columns=["fixed", "status", "problem", *COUNTED])

    return df.select(*carried, fixed(F.col(markup), idx).alias("__f")).select(*carried, "__f.*")


def fix_texts(docs: DataFrame, text: str = "text", style: str = "fine", a_grave: str = "off") -> DataFrame:
    """docs with fixed and a count for each text rule; plain texts have no paragraphs of markup and no references."""
    names = ["fixed", *(r.name for r in text_rules(style, a_grave))]
    return docs.withColumn("__f", _one_pass(style, a_grave)(F.col(text))).withColumns({n: F.col(f"__f.{n}") for n in names}).drop("__f")


def rule_totals(fixed: DataFrame, book: list[str]) -> DataFrame:
    """Counts of each rule, and of documents by status, for each book."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("changed", "unchanged", "rejected")]
    return fixed.groupBy(*book).agg(*by, *[F.sum(n).alias(n) for n in COUNTED])


def language_gate(books: DataFrame, lang: str = "lang_opf", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Books that may be treated (French, or of unknown language), and those that are refused."""
    ok = F.lit(True) if force else F.coalesce(F.lower(F.col(lang)).startswith("fr"), F.lit(True)) | (F.col(lang) == "")
    return books.filter(ok), books.filter(~ok)
