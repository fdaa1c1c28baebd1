"""Typographic audit: 29 counters of a text and its markup, summed by book, with facts about the book's container."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.functions import points as P
from quillspark.functions import text as T

CHARACTERS = {
    "apos_straight": "'",
    "apos_curly": "’",
    "dq_straight": '"',
    "dq_curly": "“”",
    "guil_open": "«",
    "guil_close": "»",
    "nbsp": T.NBSP,
    "nnbsp": T.NNBSP,
    "softhyphen": "\u00ad",
    "emdash": "—",
    "endash": "–",
    "ellipsis_char": "…",
}
NOT_SPACE = f"[^{T.SPACE}]"
#: spellings without and with the ligature; the latter list is the shorter one
OE_NOUNS = "boeufs? choeurs? coeurs? moeurs noeuds? oeil oeufs? oeuvres? soeurs? voeux? manoeuvr\\w*".split()
OE_ONLY = "oeillet\\w* oesophage\\w*".split()
ACCENTED = (
    "Éclair\\w* École Écoutez? Égypte Église Énorme\\w* Épée Époque Équipe Étage Étais Était Étang Étant État Éteins "
    "Éternel\\w* Étoile\\w* Étrange\\w* Été Évidemment Évidence Événement\\w* Être"
).split()
AFTER_A = "cause ce ces cet cette chaque côté droite gauche la le les moitié partir peine peu\\ près présent qui quoi travers votre".replace("\\ ", "~").split()
_PLAIN = str.maketrans("ÉÈÊéèê", "EEEeee")
MOJIBAKE = "\ufffd|Â[\u00a0«»]|Å\u201c|â€[\u201c\u2122œ]|Ã[\u00a0¢¤§¨©ª«®¯´¶»¼]"
DASHES = {"dlg_emdash": ("—", "&mdash;", "&#x2014;", "&#8212;"), "dlg_endash": ("–", "&ndash;", "&#x2013;", "&#8211;"), "dlg_hyphen": ("-",)}
DASH = "|".join(d for forms in DASHES.values() for d in forms)
DIALOGUE = rf"(?iU)<p[^>]*>(?:[{T.SPACE}]|<[^>]+>|&(?:nbsp|#160|#xa0|#8239);)*({DASH})"


def _any(words: list[str]) -> str:
    return "|".join(w.replace("~", " ") for w in words)


LIGATURE_BAD = rf"(?iU)\b(?:{_any(OE_NOUNS + OE_ONLY)})\b"
LIGATURE_GOOD = rf"(?iU)\b(?:{_any([w.replace('oe', 'œ') for w in OE_NOUNS])})\b"
CAPITAL_BAD = rf"(?U)\b(?:{_any([w.translate(_PLAIN) for w in ACCENTED])}|A(?= (?:{_any(AFTER_A)})\b))\b"
CAPITAL_GOOD = rf"(?U)\b(?:{_any(ACCENTED)}|À)\b"

PATTERNS = {
    "ellipsis_dots": [r"(?<!\.)\.{3}(?!\.)"],
    "punct_nbsp": [f"{T.FIXED}[!?;:]"],
    "punct_space": [f"[{T.LETTER}0-9)»…] [!?;]", f"[{T.LETTER})»] :"],
    "punct_none": [f"[{T.LETTER}][!?;]", f"[{T.LETTER}]:(?![/0-9])"],
    "guil_in_nbsp": [f"«{T.FIXED}", f"{T.FIXED}»"],
    "guil_in_space": ["« ", " »"],
    "guil_in_none": [f"(?U)«{NOT_SPACE}", f"(?U){NOT_SPACE}»"],
    "mojibake": [MOJIBAKE],
    "lig_bad": [LIGATURE_BAD],
    "lig_good": [LIGATURE_GOOD],
    "caps_bad": [CAPITAL_BAD],
    "caps_good": [CAPITAL_GOOD],
    "hyphen_residue": [f"[{T.LOWER}]- [{T.LOWER}]"],
}
TEXT_COUNTERS = ["chars", *CHARACTERS, *PATTERNS]
DIALOGUE_COUNTERS = ["dlg_emdash", "dlg_endash", "dlg_hyphen"]
COUNTERS = TEXT_COUNTERS + DIALOGUE_COUNTERS


def marks_of(text: T.Text) -> Column:
    """The counted characters of a text and no others: one pass, after which each count is one over a short string."""
    return T.sub(text, f"[^{''.join(CHARACTERS.values())}]+", "")


def text_counters(text: T.Text, marked: bool = False) -> dict[str, Column]:
    """The 26 counters of a text as native expressions, for texts that are in the JVM only; marked: its marks_of are a column __marks already."""
    t = T.col(text)
    out = {"chars": F.length(t).cast("long")}
    marks = F.col("__marks") if marked else marks_of(t)
    for name, chars in CHARACTERS.items():
        out[name] = sum((T.count_of(marks, c) for c in chars[1:]), T.count_of(marks, chars[0]))
    for name, patterns in PATTERNS.items():
        out[name] = sum((T.count_re(t, p) for p in patterns[1:]), T.count_re(t, patterns[0]))
    return out


# --- the same in one pass ---------------------------------------------------------------------------


class _Tables:
    """Tables by code point, and the spellings, made once in a process."""

    _one: "_Tables | None" = None

    def __init__(self) -> None:
        self.kind = np.zeros(P.LIMIT + 1, np.int8)
        self.kinds = list(CHARACTERS)
        for k, chars in enumerate(CHARACTERS.values()):
            self.kind[[ord(c) for c in chars]] = k + 1
        every = [chr(c) for c in range(0x100)]
        small = "".join(c for c in every if "a" <= c <= "z" or "à" <= c <= "ö" or "ø" <= c)
        letters = small + "".join(c for c in every if "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "ß")
        self.letter, self.small = P.marked(letters), P.marked(small)
        self.closing, self.before_mark = P.marked(letters + ")»"), P.marked(letters + "0123456789)»…")
        self.mark, self.any_mark, self.fixed = P.marked("!?;"), P.marked("!?;:"), P.marked(T.NBSP + T.NNBSP + T.THIN)
        self.path = P.marked("/0123456789")
        self.broken = {"Â": "\u00a0«»", "Å": "\u201c", "Ã": "\u00a0¢¤§¨©ª«®¯´¶»¼"}
        self.broken_third = P.marked("\u201c\u2122œ")
        self.broken = {ord(c): P.marked(x) for c, x in self.broken.items()}
        self.lig_bad, self.lig_good = P.Spellings(OE_NOUNS + OE_ONLY, True), P.Spellings([w.replace("oe", "œ") for w in OE_NOUNS], True)
        self.caps_bad, self.caps_good = P.Spellings([w.translate(_PLAIN) for w in ACCENTED], False), P.Spellings(ACCENTED, False)
        self.after_a = P.Spellings([w for w in AFTER_A if "~" not in w], False)
        self.peu, self.pres = P.Spellings(["peu"], False), P.Spellings(["près"], False)

    @classmethod
    def one(cls) -> "_Tables":
        cls._one = cls._one or cls()
        return cls._one


def _alternate(at: np.ndarray, apart: int) -> np.ndarray:
    """The places of matches of which none begins where the one before it ends: in a chain of them, every second."""
    if not len(at):
        return at
    head = np.flatnonzero(np.diff(at, prepend=at[0] - apart - 1) != apart)
    return at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]


def count_texts(texts: list[str]) -> np.ndarray:
    """(texts, counters of TEXT_COUNTERS), what text_counters gives."""
    t, p = _Tables.one(), P.Points(texts)
    c, n = p.code, p.n
    out: dict[str, np.ndarray] = {"chars": p.length}
    kind = t.kind[c]
    at = np.flatnonzero(kind)
    doc = np.searchsorted(p.first, at, "right") - 1
    kinds = np.bincount(doc * (len(t.kinds) + 1) + kind[at], minlength=n * (len(t.kinds) + 1)).reshape(n, -1)
    out |= {name: kinds[:, k + 1] for k, name in enumerate(t.kinds)}
    places = lambda found: p.per_text(np.flatnonzero(found))
    one, two = c[1:], c[2:]
    dot = np.flatnonzero(np.diff((c == 46).astype(np.int8)))
    out["ellipsis_dots"] = p.per_text(dot[::2][dot[1::2] - dot[::2] == 3] + 1)
    fixed, any_mark, mark = t.fixed[c], t.any_mark[c], t.mark[c]
    out["punct_nbsp"] = places(fixed[:-1] & any_mark[1:])
    gap, colon = c == 32, c == 58
    out["punct_space"] = places(t.before_mark[c[:-2]] & gap[1:-1] & mark[2:]) + places(t.closing[c[:-2]] & gap[1:-1] & colon[2:])
    letter = t.letter[c]
    out["punct_none"] = places(letter[:-1] & mark[1:]) + places(letter[:-2] & colon[1:-1] & ~t.path[two])
    opens, closes, space = c == 0xAB, c == 0xBB, P.lookup()["space"][c]
    out["guil_in_nbsp"] = places(opens[:-1] & fixed[1:]) + places(fixed[:-1] & closes[1:])
    out["guil_in_space"] = places(opens[:-1] & gap[1:]) + places(gap[:-1] & closes[1:])
    tight = np.flatnonzero(opens[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & closes[1:])
    out["guil_in_none"] = sum(p.per_text(_alternate(x, 1)) for x in tight)
    broken = c == 0xFFFD
    for first, table in t.broken.items():
        broken[:-1] |= (c[:-1] == first) & table[one]
    broken[:-2] |= (c[:-2] == 0xE2) & (c[1:-1] == 0x20AC) & t.broken_third[two]
    out["mojibake"] = places(broken)
    h = p.hashes(p.start, p.end)
    words = lambda hit: p.per_text(p.start[hit])
    out["lig_bad"], out["lig_good"] = words(t.lig_bad(p, h)), words(t.lig_good(p, h))
    alone = lambda ch: (p.end - p.start == 1) & (c[p.start] == ord(ch))
    # an A, one space, then one of the words
    near = np.zeros(len(h) + 2, bool)
    near[: max(0, len(h) - 1)] = (p.start[1:] == p.end[:-1] + 1) & gap[p.end[:-1]]
    at_a = np.flatnonzero(alone("A") & near[: len(h)])
    after, peu, pres = (np.append(x(p, h), [False, False]) for x in (t.after_a, t.peu, t.pres))
    before = at_a[after[at_a + 1] | (peu[at_a + 1] & near[at_a + 1] & pres[at_a + 2])]
    out["caps_bad"] = words(t.caps_bad(p, h)) + p.per_text(p.start[before])
    out["caps_good"] = words(t.caps_good(p, h) | alone("À"))
    small = t.small[c]
    out["hyphen_residue"] = p.per_text(_alternate(np.flatnonzero(small[:-3] & (c[1:-2] == 45) & gap[2:-1] & small[3:]), 3))
    return np.stack([out[name] for name in TEXT_COUNTERS], 1)


@F.arrow_udf(StructType([StructField(name, LongType()) for name in ["chars", *CHARACTERS, *PATTERNS]]))
def counted(texts: pa.Array) -> pa.Array:
    """TEXT_COUNTERS of each text, those of a null text 0: one Arrow pass over code points instead of some twenty regular expressions.

    Python holds some 256 texts at a time, not those of the whole batch."""
    parts = [count_texts(part) for part in P.chunks(t or "" for (t,) in T.rows(pa.record_batch([texts], ["t"])))]
    counts = np.concatenate(parts) if parts else np.zeros((0, len(TEXT_COUNTERS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(counts[:, k]) for k in range(len(TEXT_COUNTERS))], TEXT_COUNTERS)


def dialogue_counters(markup: T.Text) -> dict[str, Column]:
    """The dashes that begin paragraphs, by kind."""
    dashes = F.transform(F.regexp_extract_all(T.col(markup), F.lit(DIALOGUE), F.lit(1)), F.lower)
    among = lambda *forms: F.size(F.filter(dashes, lambda d: d.isin(*forms))).cast("long")
    return {name: among(*forms) for name, forms in DASHES.items()}


def audit_texts(docs: DataFrame, book: list[str], text: str = "text") -> DataFrame:
    """A row for each book (the columns that name it) of plain texts, dialogue counters 0; only counters are shuffled."""
    each = docs.select(*book, counted(T.col(text)).alias("__c"))
    sums = [F.coalesce(F.sum(f"__c.{n}"), F.lit(0)).cast("long").alias(n) for n in TEXT_COUNTERS]
    return each.groupBy(*book).agg(F.count("*").cast("int").alias("n_docs"), *sums).select("*", *[F.lit(0).cast("long").alias(n) for n in DIALOGUE_COUNTERS])


def audit_markup(docs: DataFrame, book: list[str], markup: str = "html") -> DataFrame:
    """A row for each book of marked-up documents: all 29 counters."""
    each = docs.select(*book, counted(T.text_audit(markup)).alias("__c"), F.struct(*[c.alias(n) for n, c in dialogue_counters(markup).items()]).alias("__d"))
    names = [*(f"__c.{n}" for n in TEXT_COUNTERS), *(f"__d.{n}" for n in DIALOGUE_COUNTERS)]
    return each.groupBy(*book).agg(F.count("*").cast("int").alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in zip(COUNTERS, names)])


#: kinds of container entries, the first that fits counts
ENTRY_KINDS = {"n_fonts": r"(?i)\.(ttf|otf|woff2?)$", "n_css": r"(?i)\.css$", "n_images": r"(?i)\.(jpe?g|png|gif|svg|webp)$"}


def _element(tag: str) -> str:
    """The text of an element."""
    return f"<{tag}[^>]*>([^<]+)</{tag}>"


def container_facts(entries: DataFrame, book: str = "book_id") -> DataFrame:
    """n_docs, n_css, n_fonts, n_images, has_ncx, has_nav, fixed_layout, lang_opf, epub_version, encoding_issues by book of entries (book, ord, name, bytes)."""
    base = F.element_at(F.split(F.lower("name"), "/"), -1)
    opf = F.when(F.col("name").rlike(r"(?i)\.opf$"), F.col("bytes"))
    facts = [F.count_if(F.col("name").rlike(p)).cast("int").alias(n) for n, p in ENTRY_KINDS.items()]
    out = entries.groupBy(book).agg(
        F.count_if(T.is_doc("name")).cast("int").alias("n_docs"),
        *facts,
        F.bool_or(F.col("name").rlike(r"(?i)\.ncx$")).alias("has_ncx"),
        F.bool_or(T.is_doc("name") & base.contains("nav")).alias("has_nav"),
        F.min_by(opf, F.when(opf.isNotNull(), F.col("ord"))).alias("__opf"),
        F.count_if(T.is_doc("name") & ~T.is_utf8("bytes")).cast("int").alias("encoding_issues"),
    )
    text = T.decoded_with_marks("__opf")
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return out.select(
        "*",
        F.coalesce(text.contains("pre-paginated"), F.lit(False)).alias("fixed_layout"),
        T.strip(found(_element("dc:language"))).alias("lang_opf"),
        found('<package(?:[^>]*)version="([^"]+)"').alias("epub_version"),
    ).drop("__opf")


def audit_library(books: DataFrame, entries: DataFrame) -> DataFrame:
    """The audit record of each book of an inventory: its fields, error for a missing or broken file, facts and counters.

    books: id, path, name, title, authors, readers, lang_db, size, error (see sources.library);
    entries: book_id, ord, name, bytes."""
    docs = entries.filter(T.is_doc("name")).select("book_id", T.decoded("bytes").alias("html"))
    counters = audit_markup(docs, ["book_id"]).drop("n_docs")
    joined = books.join(container_facts(entries).withColumnRenamed("book_id", "id"), "id", "left").join(counters.withColumnRenamed("book_id", "id"), "id", "left")
    ok = F.col("error").isNull()
    return joined.select(*books.columns, *[F.when(ok, F.coalesce(c, F.lit(0))).alias(c) if c in COUNTERS else F.col(c) for c in joined.columns if c not in books.columns])
