"""Column helpers for markup and text: fragments, segments, the seven text projections, counting.

Native expressions throughout; the two Arrow functions are those that Spark
has no expression for: character references (the HTML 5 table) and the
stateful split of markup into segments.

Patterns that use \\w, \\s or \\b carry (?U), so that they mean Unicode classes.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
LOWER = "a-zà-öø-ÿ"
NBSP, NNBSP, THIN = "\u00a0", "\u202f", "\u2009"
FIXED = f"[{NBSP}{NNBSP}{THIN}]"
SPACE = r"\s\x1c-\x1f"  # inside a class, under (?U)
TAG = "<[^>]+>"
#: a tag, or a run of text; a "<" that opens no tag belongs to the text
FRAGMENT = r"(?s)<[^>]+>|[^<]+(?:<(?![^>]+>)[^<]*)*|(?:<(?![^>]+>)[^<]*)+"
SKIPPED = ("code", "pre", "script", "style", "svg")
INLINE = ("a", "b", "em", "i", "small", "span", "strong", "sub", "sup", "u")
DOC_NAME = r"(?i)\.(?:xhtml|html|htm)$"
HEAD = r"(?is)<head\b.*?</head>"
STYLE = r"(?is)<style\b.*?</style>"

Text = Column | str


def col(t: Text) -> Column:
    return F.col(t) if isinstance(t, str) else t


def count_of(t: Text, literal: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    t = col(t)
    return ((F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def count_re(t: Text, pattern: str) -> Column:
    return F.regexp_count(col(t), F.lit(pattern)).cast("long")


def sub(t: Text, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(t), F.lit(pattern), F.lit(by))


def strip(t: Text) -> Column:
    """Without white space of any kind at both ends."""
    return sub(t, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def words(t: Text) -> Column:
    """Number of parts between white space of any kind."""
    return F.regexp_count(col(t), F.lit(rf"(?U)[^{SPACE}]+")).cast("long")


def escape(t: Text) -> Column:
    t = F.replace(col(t), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_doc(name: Text) -> Column:
    return col(name).rlike(DOC_NAME)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Text for all character references; null stays null."""
    return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def unescaped(t: Text) -> Column:
    return unescape(col(t))


#: characters beyond the usual ones, among which combining marks may be
ODD = re.compile("[\u0300-\u1fff\u20d0-\U0010ffff]")


@functools.cache
def with_marks(pattern: str) -> str:
    """A pattern for Python in which combining marks belong to words, as they do in (?U) patterns; only texts with ODD characters need it."""
    marks = [c for c in range(0x300, 0x110000) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for k, c in enumerate(marks) if not k or marks[k - 1] != c - 1]
    ends = [c for k, c in enumerate(marks) if k + 1 == len(marks) or marks[k + 1] != c + 1]
    word = r"[\w" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]"
    edge = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    return pattern.replace(r"\w", word).replace(r"\b", edge)


def rows(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch, of which Python holds a few at a time."""
    for i in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, step).columns))


# --- decoding ---------------------------------------------------------------------


def decoded(b: Text) -> Column:
    """UTF-8, else Latin-1."""
    b = col(b)
    return F.when(F.expr("is_valid_utf8(cast({0} as string))".format(_name(b))), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def is_utf8(b: Text) -> Column:
    return F.expr("is_valid_utf8(cast({0} as string))".format(_name(col(b))))


def decoded_with_marks(b: Text) -> Column:
    """UTF-8 with U+FFFD where it isn't valid."""
    return F.expr("make_valid_utf8(cast({0} as string))".format(_name(col(b))))


def _name(c: Column) -> str:
    return "`" + c._jc.toString().strip("`") + "`"


# --- fragments and segments -----------------------------------------------------------


def fragments(markup: Text) -> Column:
    """Tags and texts, in order; joined they are the markup."""
    return F.regexp_extract_all(col(markup), F.lit(FRAGMENT), F.lit(0))


def is_tag(fragment: Text) -> Column:
    return col(fragment).startswith("<")


def tag_name(fragment: Text) -> Column:
    return F.lower(F.regexp_extract(col(fragment), r"^</?[\s]*([0-9A-Za-z]+)", 1))


def skip_step(fragment: Text) -> Column:
    """1 for a tag that opens a skipped zone, -1 for one that closes it, else 0."""
    fragment = col(fragment)
    hit = is_tag(fragment) & tag_name(fragment).isin(*SKIPPED)
    return F.when(hit & fragment.startswith("</"), -1).when(hit, 1).otherwise(0)


_SPLIT = re.compile("(<[^>]+>)")
_NAME = re.compile(r"</?\s*([0-9A-Za-z]+)")
SEGMENTS = ArrayType(StructType([StructField("text", StringType()), StructField("kind", IntegerType()), StructField("para", BooleanType())]))
RAW, PLAIN = 0, 1


def split_segments(markup: str) -> list[tuple[str, int, bool]]:
    """(fragment, kind, whether it begins a paragraph); a PLAIN fragment's references are resolved, a RAW one is a tag or in a skipped zone."""
    out, depth, para = [], 0, False
    for f in _SPLIT.split(markup):
        if not f:
            continue
        if f[0] == "<":
            closing = f.startswith("</")
            m = None if f.startswith("<!--") else _NAME.match(f)
            tag = m.group(1).lower() if m else ""
            if tag in SKIPPED:
                depth = max(0, depth - 1 if closing else depth + 1)
            if closing:
                para = para and tag != "p"
            elif not f.startswith("<!--"):
                para = tag == "p" or (para and (tag in INLINE or tag == "br"))
            out.append((f, RAW, False))
        elif depth:
            out.append((f, RAW, False))
        else:
            t = html.unescape(f)
            out.append((t, PLAIN, para))
            para = para and not t.strip()
    return out


@F.pandas_udf(SEGMENTS)
def segments(s: pd.Series) -> pd.Series:
    """Segments of markup, in order, with the state that rules need: one pass, no shuffle."""
    return s.map(lambda m: None if m is None else [{"text": t, "kind": k, "para": p} for t, k, p in split_segments(m)])


def rebuilt(segs: Text) -> Column:
    """Markup of the segments, PLAIN ones escaped again."""
    return F.array_join(F.transform(col(segs), lambda s: F.when(s["kind"] == PLAIN, escape(s["text"])).otherwise(s["text"])), "")


# --- projections of markup to text ------------------------------------------------------


def text_audit(markup: Text) -> Column:
    return unescape(sub(sub(sub(markup, HEAD, ""), STYLE, ""), TAG, ""))


def text_lexicon(markup: Text) -> Column:
    t = unescape(sub(sub(markup, HEAD, ""), TAG, " "))
    return F.replace(F.lower(nfc(t)), F.lit("’"), F.lit("'"))


def _paragraphs(t: Column) -> Column:
    return strip(sub(unescape(sub(sub(t, "(?i)</p>", "\n\n"), TAG, "")), "\n{3,}", "\n\n"))


def text_sample(markup: Text) -> Column:
    return _paragraphs(sub(sub(markup, HEAD, ""), STYLE, ""))


def text_chapter(markup: Text) -> Column:
    return _paragraphs(sub(markup, HEAD, ""))


def text_anomaly(markup: Text) -> Column:
    """Plain segments after the head, joined by line feeds."""
    plain = F.filter(segments(sub(markup, HEAD, "")), lambda s: s["kind"] == PLAIN)
    return F.array_join(F.transform(plain, lambda s: s["text"]), "\n")


def text_check(markup: Text) -> Column:
    return unescape(sub(sub(markup, r"(?is)<(script|style)\b.*?</\1>", ""), TAG, "\x00"))


def text_license(markup: Text) -> Column:
    return sub(sub(markup, HEAD, ""), TAG, " ")
