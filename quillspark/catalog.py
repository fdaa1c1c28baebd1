"""All queries of the reference operators, with the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import damage, state
from quillspark.functions import text as T
from quillspark.operators import anomalies, apply, audit, boilerplate, corpus, rules, score
from quillspark.plans import pipelines
from quillspark.plans import sqltext as S
from quillspark.sinks import books as sink
from quillspark.sources import library, tables
from quillspark.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "audit_ranking"
BOOK = ["source", "lang"]
CUT = {"target": 2500, "overlap": 40, "separator": "\n"}


def query(sql: str | None = None):
    """Registers a function (documents, pages, ... by name of its parameters) as a query."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            names = f.__code__.co_varnames[: f.__code__.co_argcount]
            return f(*[{"spark": spark, "sf_dir": sf_dir}.get(n) or tables.table(spark, sf_dir, n) for n in names])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _damaged(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", damage.damaged("text"))


# --- audit and score ------------------------------------------------------------------------------


@query(S.counters_by_book())
def audit_counters(documents):
    return audit.audit_texts(_damaged(documents), BOOK).select(*BOOK, "n_docs", *audit.TEXT_COUNTERS)


@query(
    f"""with p as (select page_id, list_transform(regexp_extract_all(replace(replace(html, '<p>A', '<p>— A'), '<p>T', '<p><i>- T'), {S.quoted(rf"(?i)<p[^>]*>(?:[{S.BLANK}]|<[^>]+>|&(?:nbsp|#160|#xa0|#8239);)*({audit.DASH})")}, 1), lambda x: lower(x)) as d from pages)
select page_id, len(list_filter(d, lambda x: x in {S.among(audit.DASHES['dlg_emdash'])}))::bigint as dlg_emdash,
  len(list_filter(d, lambda x: x in {S.among(audit.DASHES['dlg_endash'])}))::bigint as dlg_endash, len(list_filter(d, lambda x: x = '-'))::bigint as dlg_hyphen from p"""
)
def audit_dialogue(pages):
    html = F.replace(F.replace(F.col("html"), F.lit("<p>A"), F.lit("<p>— A")), F.lit("<p>T"), F.lit("<p><i>- T"))
    return pages.select("page_id", html.alias("html")).select("page_id", *[c.alias(n) for n, c in audit.dialogue_counters("html").items()])


def _classified(documents: DataFrame) -> DataFrame:
    return score.classify(audit.audit_texts(_damaged(documents), BOOK).withColumn("lang_db", F.col("lang")))


@query(S.classified())
def score_classes(documents):
    return _classified(documents).select(*BOOK, "cls", "score", F.size("defects").alias("n_defects"))


@query(S.ranking())
def audit_ranking(documents):
    ranked = score.ranked(_classified(documents), *BOOK)
    return ranked.select(*BOOK, "cls", "score", F.size("defects").alias("n_defects"), "place")


@query(f"select cls, count(*) as books from ({S.classified()}) group by cls")
def class_counts(documents):
    return score.class_counts(_classified(documents))


def _heads(defects: Column) -> Column:
    return F.array_join(F.transform(defects, lambda d: F.left(d, F.lit(12))), "|")


@query(f"select cls as classe, score, ('0x' || substring(md5(source || '-' || lang), 1, 8))::bigint as id, source || '-' || lang as titre, '' as auteurs, '' as lecteurs, heads as defauts from ({S.scored(S.record_defaults(S.counters_by_book(), 'lang'), 'source, lang')})")
def ranking_report(documents):
    """The report's columns; of each defect the first 12 characters, as decimals are rounded differently in SQL."""
    title = F.concat_ws("-", *BOOK)
    named = _classified(documents).withColumn("id", F.conv(F.substring(F.md5(title), 1, 8), 16, 10).cast("long")).withColumn("title", title)
    named = named.withColumn("authors", F.lit(None).cast("string")).withColumn("readers", F.lit(""))
    return sink.ranking_csv(named).withColumn("defauts", _heads(F.split("defauts", r" \| ")))


@query(S.scored(S.grid_rows(), "k"))
def score_rules(orders):
    """Each rule and class of the score on both sides of its threshold, from made-up audit records."""
    rows = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).select("k", *[F.expr(e).alias(n) for n, e in S.GRID.items()])
    return score.classify(rows).select("k", "cls", "score", F.size("defects").alias("n_defects"), _heads(F.col("defects")).alias("heads"))


# --- markup ------------------------------------------------------------------------------------------


@query(
    f"with {S.fragment_rows()} select page_id, count(*) as fragments, count(*) filter (is_tag) as tags, count(*) filter (in_skip) as skipped, coalesce(sum(length(fragment)) filter (not is_tag and not in_skip), 0)::bigint as plain_chars from f group by page_id"
)
def html_fragments(pages):
    rows = state.fragment_rows(pages, ["page_id"])
    plain = F.when(~F.col("is_tag") & ~F.col("in_skip"), F.length("fragment"))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("fragments"), F.count_if("is_tag").alias("tags"), F.count_if("in_skip").alias("skipped"), F.coalesce(F.sum(plain), F.lit(0)).cast("long").alias("plain_chars")
    )


@query("select page_id, " + ", ".join(f"md5({sql}) as {k}" for k, sql in S.projections().items()) + " from pages")
def text_projections(pages):
    p = {"audit": T.text_audit, "lexicon": T.text_lexicon, "sample": T.text_sample, "chapter": T.text_chapter, "license": T.text_license}
    return pages.select("page_id", *[F.md5(F.encode(f("html"), "UTF-8")).alias(k) for k, f in p.items()])


@query(
    f"""with g as (select page_id, {S.removed('html', S.HEAD)} as html from pages), {S.fragment_rows().replace('from pages', 'from g')}
select page_id, md5(coalesce(string_agg({S.unescaped('fragment')}, chr(10) order by ord) filter (not is_tag and not in_skip), '')) as anomaly from f group by page_id"""
)
def segment_text(pages):
    return pages.select("page_id", F.md5(F.encode(T.text_anomaly("html"), "UTF-8")).alias("anomaly"))


@query(
    " union all ".join(
        f"select page_id, '{b}' as tag, len(regexp_extract_all(html, '(?i)<{b}[\\s>]'))::bigint as opens, len(regexp_extract_all(html, '(?i)</{b}\\s*>'))::bigint as closes from pages" for b in boilerplate.BLOCKS
    )
)
def tag_balance(pages):
    return pages.select("page_id", F.explode(boilerplate.tag_balance("html")).alias("tag", "n")).select("page_id", "tag", "n.opens", "n.closes")


@query(
    """with p as (select page_id, replace(replace(html, '<h1>', '<h1 id="top">'), '<p>', '<p name="t">') as html from pages),
a as (select page_id, unnest(list_distinct(regexp_extract_all(case when regexp_matches(html, '(?is)<body(?:[^>]*)>.*</body>') then regexp_extract(html, '(?is)<body(?:[^>]*)>(.*)</body>', 1) else html end, '\\b(?:name|id)\\s*=\\s*["'']([^"'']+)["'']', 1))) as anchor from p)
select page_id, anchor from a"""
)
def anchors(pages):
    html = F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit('<h1 id="top">')), F.lit("<p>"), F.lit('<p name="t">'))
    return pages.select("page_id", F.explode(boilerplate.anchors(html)).alias("anchor"))


# --- words ---------------------------------------------------------------------------------------------

_LEXICON = "select word, count(*) as books from (select distinct source, unnest(regexp_extract_all(replace(lower(text), '’', ''''), '{p}')) as word from documents) group by word having count(*) >= 2".format(
    p=corpus.LEXICON_WORD.replace("'", "''")
)
_FORMS = f"select source, unnest(regexp_extract_all({damage.damaged_sql()}, {S.quoted(anomalies.WORD)})) as form from documents"
_WORDS = rf"""select source, word, count(*) as n, bool_or(small) as seen_lower from (select source, regexp_replace(replace(lower(nfc_normalize(form)), '’', ''''), {S.quoted(anomalies.ELIDED)}, '') as word,
  form[1] <> upper(form[1]) as small from ({_FORMS})) group by source, word"""


@query(_LEXICON)
def lexicon(documents):
    return corpus.lexicon(documents, ["source"])


@query(_WORDS)
def word_frequency(documents):
    return anomalies.book_words(_damaged(documents), ["source"])


_UNKNOWN = f"select source, word, n from ({_WORDS}) w where n < 3 and seen_lower and length(word) >= 3 and regexp_matches(word, '^[{anomalies.SMALL}][{anomalies.SMALL}''’-]*$') and word not in (select word from ({_LEXICON}))"


@query(_UNKNOWN)
def unknown_words(documents):
    return anomalies.unknown_words(_damaged(documents), ["source"], corpus.lexicon(documents, ["source"]))


# --- anomalies ---------------------------------------------------------------------------------------------


@query(S.anomaly_counts())
def anomaly_counts(documents):
    return anomalies.count_by_book(_damaged(documents), BOOK).filter("type <> 'mot_double'")


@query(S.doubled_words())
def doubled_words(documents):
    return anomalies.count_by_book(_damaged(documents), BOOK, types=["mot_double"]).select(*BOOK, "n")


def _unknown(documents: DataFrame, words: DataFrame, first: str | None = None) -> DataFrame:
    return anomalies.unknown_words(_damaged(documents), ["source"], words, first=first)


@query(S.anomaly_rows(_UNKNOWN, _LEXICON))
def anomaly_records(documents):
    """The records, with context, of the detectors whose places SQL can find; the cap counts those of each type."""
    kinds = ["mot_inconnu", "cesure_residuelle", "abrev_m", "guillemet_desequilibre", "quatre_points"]
    words = corpus.lexicon(documents, ["source"])
    found = anomalies.first_records(_damaged(documents), ["source"], "doc_id", unknown=_unknown(documents, words, "doc_id"), lexicon=words, types=kinds)
    return found.select("source", "doc_id", "type", "pos", "avant", "extrait", "apres", "suggestion")


@query(
    f"""with s as (select source, type, sum(n)::bigint as n from ({S.anomaly_counts()}) group by all union all select source, 'mot_double', sum(n)::bigint from ({S.doubled_words()}) group by all union all select source, 'mot_inconnu', sum(n)::bigint from ({_UNKNOWN}) group by all)
select source, type, n, least(n, {anomalies.PER_TYPE}) as kept from s where n > 0"""
)
def anomaly_statistics(documents):
    """All records of each type and book, and how many the cap leaves."""
    unknown = _unknown(documents, corpus.lexicon(documents, ["source"]))
    return anomalies.totals(_damaged(documents), ["source"], unknown=unknown).select("source", "type", "n", "kept")


# --- rules ------------------------------------------------------------------------------------------------------


@query(f"select doc_id, md5(f) as fixed, length(f)::int as chars from (select doc_id, {S.fixed_text()} as f from (select doc_id, {damage.damaged_sql()} as t from documents))")
def fix_texts(documents):
    fixed = rules.corrected(damage.damaged("text"))
    return documents.select("doc_id", fixed.alias("f")).select("doc_id", F.md5(F.encode("f", "UTF-8")).alias("fixed"), F.length("f").alias("chars"))


@query(S.fixed_counts())
def fix_rule_counts(documents):
    counted = rules.fix_texts(_damaged(documents))
    return counted.groupBy("source").agg(*[F.sum(r.name).alias(r.name) for r in rules.text_rules()])


def _fixed(pages: DataFrame, pairs: list[tuple[str, str]], **options) -> DataFrame:
    done = rules.fix_documents(pages.select("page_id", damage.damaged("html", pairs).alias("html")), **options)
    return done.select("page_id", "status", F.md5(F.encode("fixed", "UTF-8")).alias("fixed"), *rules.COUNTED)


@query(S.fixed_pages(damage.MARKUP, T.NBSP, wordlist=True, mojibake=True))
def fix_documents(pages):
    return _fixed(pages, damage.MARKUP, style="nbsp", a_grave="wordlist", mojibake=True)


@query(S.fixed_pages(damage.CAPITAL_A, T.NNBSP, decided=True))
def fix_decisions(pages):
    """Every second isolated A of a page approved, more than it may have."""
    chosen = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.length("html"), F.lit(2))).alias("idx"))
    return _fixed(pages, damage.CAPITAL_A, decisions=chosen, key=["page_id"])


# --- candidates, windows, samples ------------------------------------------------------------------------------


_CANDIDATES = rf"""with {S.damaged_parts()},
c as (select doc_id, t, list_sum(list_transform(l[:i - 1], lambda x: length(x))) as before, i from (select doc_id, t, l, unnest(list_filter(range(1, len(l) + 1), lambda i: l[i] = 'A' and l[i + 1] = ' ' and regexp_matches(l[i + 2], '^{S.LOW}'))) as i from d)),
p as (select doc_id, t, coalesce(before, 0)::int as b, row_number() over (partition by doc_id order by i)::int - 1 as idx from c)
select doc_id, idx::int as idx, regexp_replace(substring(t, greatest(b - 59, 1), least(b, 60)), '^[{S.BLANK}]+', '') as avant, regexp_replace(substring(t, b + 1, 70), '[{S.BLANK}]+$', '') as apres from p"""


@query(_CANDIDATES)
def a_candidates(documents):
    return corpus.candidates(_damaged(documents), ["doc_id"])


@query(f"select * from ({_CANDIDATES}) where idx % 2 = 0")
def a_decisions(documents):
    found = corpus.candidates(_damaged(documents), ["doc_id"])
    return corpus.approved(found, found.select("doc_id", "idx", (F.col("idx") % 2 == 0).alias("accentuer")), ["doc_id"])


@query(S.windows(**CUT))
def windows(documents):
    return corpus.windows(documents, ["doc_id"], **CUT)


@query(
    """with d as (select source, doc_id, format('{:09d}', doc_id) as name, text from documents),
n as (select *, row_number() over o - 1 as i, count(*) over (partition by source) as n, lead(text, 1) over o as t1, lead(text, 2) over o as t2, lead(text, 3) over o as t3,
  lead(name, 1) over o as n1, lead(name, 2) over o as n2, lead(name, 3) over o as n3 from d window o as (partition by source order by name)),
p as (select *, case when not (length(text) < 200 and n > 5) then 0 when length(t1) >= 200 then 1 when length(t2) >= 200 then 2 when length(t3) >= 200 then 3 else 4 end as k from n
  where i = least(1, n - 1) or i = n // 2 or i = case when n > 2 then n - 2 else n - 1 end)
select source, i::int as place, case k when 1 then n1 when 2 then n2 when 3 then n3 else name end as name,
  substring(case k when 0 then text when 1 then t1 when 2 then t2 when 3 then t3 else coalesce(t3, t2, t1, text) end, 1, 1500) as extract from p"""
)
def samples(documents):
    return corpus.samples(documents.withColumn("name", F.format_string("%09d", "doc_id")), ["source"])


@query(f"select page_id, length(t)::int as chars, md5(t) as text from (select page_id, {S.projections()['chapter']} as t from pages) where length(t) >= 100")
def chapters(pages):
    return corpus.chapters(pages).select("page_id", "chars", F.md5(F.encode("text", "UTF-8")).alias("text"))


# --- corrections ----------------------------------------------------------------------------------------------------


def _proposals(documents: DataFrame) -> DataFrame:
    """Three synthetic corrections a document: one that fits, one that is too short, one beyond the bounds."""
    t = F.col("text")
    base = documents.filter(F.length(t) > 120).select("source", F.col("doc_id").cast("string").alias("doc"), t)
    made = F.array(
        F.struct(F.substring(t, 11, 24).alias("chercher"), F.concat(F.substring(t, 11, 23), F.lit("é")).alias("remplacer")),
        F.struct(F.substring(t, 41, 5).alias("chercher"), F.lit("autre").alias("remplacer")),
        F.struct(F.substring(t, 61, 20).alias("chercher"), F.repeat(F.lit("long "), F.lit(9)).alias("remplacer")),
    )
    rows = base.select("source", "doc", F.posexplode(made).alias("ord", "c"))
    return rows.select("source", "doc", F.col("ord").cast("long").alias("ord"), "c.chercher", "c.remplacer", F.lit("essai").alias("raison"), F.lit("lecture-1").alias("source_"))


_PROPOSALS = """select source, doc, ord, chercher, remplacer from (select source, doc_id::varchar as doc, unnest([0, 1, 2])::bigint as ord,
  unnest([substring(text, 11, 24), substring(text, 41, 5), substring(text, 61, 20)]) as chercher, unnest([substring(text, 11, 23) || 'é', 'autre', repeat('long ', 9)]) as remplacer
  from documents where length(text) > 120) where chercher <> remplacer and chercher <> ''"""


@query(
    f"""with c as ({_PROPOSALS}), b as (select *, levenshtein(chercher, remplacer) as e, abs({S.n(f'[^{S.BLANK}]+', 'remplacer')} - {S.n(f'[^{S.BLANK}]+', 'chercher')}) as w from c)
select source, doc, ord, case when length(chercher) < 8 then 'short' when e > 12 or w > 2 or abs(length(remplacer) - length(chercher)) > 60 then 'beyond' else 'fits' end as verdict from b"""
)
def correction_bounds(documents):
    judged = apply.bounded(apply.usable(_proposals(documents)))
    verdict = F.when(F.col("refusal").isNull(), "fits").when(F.col("refusal").startswith("motif"), "short").otherwise("beyond")
    return judged.select("source", "doc", "ord", verdict.alias("verdict"))


@query(
    f"""with w as (select source, sum({S.n(f'[^{S.BLANK}]+', 'text')})::bigint as words from documents group by source), c as (select source, count(*) as asked from ({_PROPOSALS}) group by source)
select source, words, greatest(25, floor(words * 0.2::double / 100))::bigint as budget, coalesce(asked, 0)::bigint as asked, coalesce(asked, 0) <= greatest(25, floor(words * 0.2::double / 100)) as within from w left join c using (source)"""
)
def correction_budgets(documents):
    return apply.budgets(documents, _proposals(documents), ["source"], "text")


def _requests(documents: DataFrame) -> DataFrame:
    """Corrections of every kind that the applier tells apart, all over the text; each document is a book."""
    x = documents.filter("text is not null").select(F.col("doc_id").alias("book"), F.replace("text", F.lit(" e"), F.lit(f"{T.NBSP}e")).alias("t"), F.length("text").alias("n"))
    spot = lambda at, n: F.expr(f"substring(t, cast({at} as int), {n})")
    half, plain = spot("n div 2", 23), F.replace(spot("3 * n div 4", 20), F.lit(T.NBSP), F.lit(" "))
    made = [
        (spot("n div 2", 24), F.concat(half, F.lit("é"))), (F.concat(half, F.lit("é")), F.concat(half, F.lit("ée"))), (F.lit("zzzzzzzz absent"), F.lit("zzzzzzzz absents")),
        (spot("n div 3", 5), F.lit("autre")), (spot("n div 4", 20), F.repeat(F.lit("long "), F.lit(9))), (spot("n div 5", 30), spot("n div 5", 12)), (plain, F.concat(plain, F.lit("s"))),
    ]
    one = lambda doc, k, a, b: F.struct(F.lit(doc).alias("doc"), F.lit(k).cast("long").alias("ord"), a.alias("chercher"), b.alias("remplacer"))
    first = F.array(*[one("d", k, a, b) for k, (a, b) in enumerate(made)], one("absent", 99, F.lit("zzzz orphan"), F.lit("zzzz orphans")))
    more = F.array(*[one("d", k, F.lit(f"zzzz {k}"), F.lit("zzzz s")) for k in range(7, 7 + S.FILLERS)])
    rows = x.filter("n > 120").select("book", F.inline(F.when(F.col("n") > 3000, F.concat(first, more)).otherwise(first)))
    return rows.select("*", F.lit("essai").alias("raison"), F.lit("lecture-1").alias("source"))


def _marked_up(documents: DataFrame) -> DataFrame:
    t = T.escape(F.replace("text", F.lit(" e"), F.lit(f"{T.NBSP}e")))
    return documents.filter("text is not null").select(F.col("doc_id").alias("book"), F.lit("d").alias("doc"), F.concat(F.lit("<p>"), t, F.lit("</p>")).alias("html"))


@query(S.outcomes())
def apply_corrections(documents):
    done = apply.apply_corrections(_marked_up(documents), _requests(documents), ["book"]).outcomes
    return done.select("book", "doc", F.col("ord").cast("int").alias("ord"), "status", F.element_at(F.split("reason", r" \("), 1).alias("reason"), "actual")


@query(f"{S.applied()} select book, md5(fixed) as fixed from z")
def corrected_documents(documents):
    done = apply.apply_corrections(_marked_up(documents), _requests(documents), ["book"]).docs
    return done.select("book", F.md5(F.encode("fixed", "UTF-8")).alias("fixed"))


@query(f"select source, doc, ord from ({_PROPOSALS}) where doc not in (select doc_id::varchar from labels)")
def correction_orphans(documents, labels):
    docs = labels.select(F.col("doc_id").cast("string").alias("doc"))
    return apply.orphans(_proposals(documents), docs, []).select("source", "doc", "ord")


# --- inventories -------------------------------------------------------------------------------------------------------


@query("select doc_id, source, lang from documents where doc_id not in (select doc_id from labels)")
def pending_books(documents, labels):
    return corpus.pending(documents.select("doc_id", "source", "lang"), labels, "doc_id")


@query("select doc_id, source, lang from documents where doc_id in (select doc_id from labels)")
def chosen_books(documents, labels):
    return corpus.chosen(documents.select(F.col("doc_id").alias("id"), "source", "lang"), labels.select(F.col("doc_id").alias("id"))).withColumnRenamed("id", "doc_id")


# --- boilerplate, metadata, containers -----------------------------------------------------------------------------------

_META = boilerplate.Metadata("Un titre", "Une autrice", "note")


def _cases(key: str, values: list) -> Column:
    """The value for key modulo their number."""
    out = F.when(F.col(key) % len(values) == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.col(key) % len(values) == k, v)
    return out


def _with_id(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{0}"), F.col("page_id").cast("string"))


@query(S.stripped_pages())
def boilerplate_cut(pages):
    """Each marker, the licence, a page that names nothing, and one that the drift guard leaves alone."""
    marked = pages.select("page_id", _cases("page_id", [damage.damaged("html", pairs) for pairs in S.BOILERPLATE]).alias("html"))
    return boilerplate.strip_documents(marked).select("page_id", "removed", "drift", "dropped", F.md5(F.encode("stripped", "UTF-8")).alias("stripped"))


@query(S.pruned_pages())
def pruned_packages(pages):
    """Manifest, spine and navigation after files were dropped."""
    gone = _cases("page_id", [F.array().cast("array<string>"), F.array(_with_id("a{0}.xhtml"), _with_id("b{0}.xhtml")), F.array(_with_id("c{0}.xhtml"))])
    ncx = boilerplate.pruned_navigation(_with_id(S.navigation("p", "q", "r", "s", first=0)), F.array(F.lit("top"), F.lit("kept")), gone)
    return pages.select("page_id", boilerplate.pruned_package(_with_id(S.PACKAGE), gone).alias("opf"), ncx.alias("ncx"))


@query(S.cleaned_pages(_META))
def clean_metadata(pages):
    opf = _cases("page_id", [_with_id(x) for x in S.METADATA])
    return pages.select("page_id", boilerplate.clean_package(opf, _META).alias("opf"), boilerplate.navigation_id(_with_id(S.NAVIGATION), _META).alias("ncx"))


@query(S.library_books())
def library_audit(pages):
    """E-books of ten pages each, packed, unpacked, audited, classified and ranked; some are broken, missing, of pictures, in Latin-1."""
    book = F.floor(F.col("page_id") / 10)
    case = F.col("b") % S.BOOK_CASES
    p = pages.select(book.alias("b"), "page_id", "html")
    text = F.when(case == 4, F.encode(T.sub(damage.damaged("html", S.DASHED), "[^\\x00-\\xFF]", "?"), "ISO-8859-1")).when(case == 1, F.encode(F.lit("<p>x</p>"), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    docs = p.select("b", (F.col("page_id") % 10 + 20).cast("int").alias("ord"), F.concat(F.lit("t/c"), "page_id", F.lit(".xhtml")).alias("name"), text.alias("bytes"))
    opf = F.concat(F.lit('<package version="2.0"><dc:language> '), F.when(case == 5, "en").otherwise("fr-FR"), F.lit(" </dc:language>"), F.when(case == 1, '<meta content="pre-paginated"/>').otherwise(""), F.lit("</package>"))
    raw = lambda s: F.encode(F.lit(s), "UTF-8")
    parts = [("b.opf", F.encode(opf, "UTF-8")), ("toc.ncx", raw("<ncx/>")), ("nav.xhtml", raw("")), ("s.css", raw("p{}")), ("f.otf", raw("-")), ("i.png", raw("-")), ("j.JPEG", raw("-"))]
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), x.alias("bytes")) for k, (n, x) in enumerate(parts)])
    others = p.select("b").distinct().select("b", F.inline(rows))
    entries = docs.unionByName(others).withColumn("zdate", F.lit(None).cast("array<int>")).withColumnRenamed("b", "book_id")
    made = sink.packed(entries).select(F.col("book_id").alias("id"), F.when(F.col("book_id") % 6 == 2, F.encode(F.lit("broken"), "UTF-8")).when(F.col("book_id") % 6 != 3, F.col("content")).alias("content"))
    again = library.entries(made)
    errors = made.join(library.failures(again), "id", "left").select("id", F.when(F.col("content").isNull(), F.lit("epub_not_found")).otherwise(F.col("error")).alias("error"), F.lit("fr").alias("lang_db"))
    ranked = pipelines.audit_and_rank(errors, again.filter("ord >= 0"))
    nothing = {"lang_opf": "", "epub_version": "", "fixed_layout": False, "has_ncx": False, "has_nav": False, "error": ""}
    facts = ["n_docs", "n_css", "n_fonts", "n_images", "encoding_issues", *audit.COUNTERS]
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in (nothing | dict.fromkeys(facts, 0)).items()]
    return ranked.select("id", *filled, "cls", "score", F.size("defects").alias("n_defects"), _heads(F.col("defects")).alias("heads"), "place")


@query("select page_id // 50 as book_id, 'doc-' || page_id || '.xhtml' as name, md5(html) as content from pages")
def container_roundtrip(pages):
    """Packed as e-books and unpacked again."""
    made = pages.select(
        F.floor(F.col("page_id") / 50).alias("book_id"), F.col("page_id").cast("int").alias("ord"), F.concat(F.lit("doc-"), "page_id", F.lit(".xhtml")).alias("name"),
        F.encode("html", "UTF-8").alias("bytes"), F.array(*[F.lit(x) for x in (2020, 1, 1, 0, 0, 0)]).alias("zdate"),
    )
    again = library.entries(sink.packed(made).withColumnRenamed("book_id", "id"), T.DOC_NAME)
    return again.filter(T.is_doc("name")).select("book_id", "name", F.md5("bytes").alias("content"))


# --- streaming -----------------------------------------------------------------------------------------------------------------


@query("select source, lang, count(*) as n_docs, sum(length(text))::bigint as chars, sum({b})::bigint as punct_none from documents group by source, lang".format(b=S.text_counters()["punct_none"].replace("(t,", "(text,")))
def stream_audit(spark, sf_dir):
    """Documents as a stream, audited as they arrive; the result is read from what the stream appended."""
    base = f"{tables.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith("/documents.parquet"):  # one file: a stream reads folders
        stream = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(path)
    incremental.audit_stream(stream.select("doc_id", *BOOK, "text"), ["doc_id"], "text", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy(*BOOK).agg(F.count("*").alias("n_docs"), F.sum("chars").alias("chars"), F.sum("punct_none").alias("punct_none"))
