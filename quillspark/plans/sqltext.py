"""Pieces of DuckDB SQL that state what the column expressions compute, in its regular expressions (no look-around, ASCII \\b and \\w)."""

from __future__ import annotations

from functools import reduce

from quillspark.functions import text as T
from quillspark.functions.damage import damaged_sql, quoted
from quillspark.operators import anomalies, audit, boilerplate, rules

W = r"\p{L}\p{M}\p{N}_"
LOW = "[a-zà-öø-ÿ]"
L = T.LETTER
FIXED = r"[\x{00A0}\x{202F}\x{2009}]"
BLANK = r"\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}"


def n(pattern: str, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, {quoted(pattern)}))"


def chars(c: str, t: str = "t") -> str:
    return f"(length({t}) - length(replace({t}, {quoted(c)}, '')))"


def among(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def parts(t: str = "t") -> str:
    """The text as alternating runs of word and other characters."""
    return f"regexp_extract_all({t}, '[{W}]+|[^{W}]+')"


def at(condition: str, x: str = "l") -> str:
    """Number of places i of the parts where a condition holds."""
    return f"len(list_filter(range(1, len({x}) + 1), lambda i: coalesce({condition}, false)))"


def tokens_like(pattern: str, fold: bool = False) -> str:
    token = "lower(x)" if fold else "x"
    return f"len(list_filter(l, lambda x: regexp_full_match({token}, {quoted(pattern)})))"


def _plain(words: list[str]) -> str:
    return "|".join(w.replace(r"\w*", f"[{W}]*") for w in words)


def text_counters() -> dict[str, str]:
    """Of t and its parts l."""
    out = {"chars": "length(t)"}
    for name, cs in audit.CHARACTERS.items():
        out[name] = " + ".join(chars(c) for c in cs)
    out["ellipsis_dots"] = r"len(list_filter(regexp_extract_all(t, '\.+'), lambda x: length(x) = 3))"
    out["punct_nbsp"] = n(f"{FIXED}[!?;:]")
    out["punct_space"] = n(f"[{L}0-9)»…] [!?;]") + " + " + n(f"[{L})»] :")
    out["punct_none"] = f"{n(f'[{L}][!?;]')} + {n(f'[{L}]:')} - {n(f'[{L}]:[/0-9]')}"
    out["guil_in_nbsp"] = n(f"«{FIXED}") + " + " + n(f"{FIXED}»")
    out["guil_in_space"] = n("« ") + " + " + n(" »")
    out["guil_in_none"] = n(f"«[^{BLANK}]") + " + " + n(f"[^{BLANK}]»")
    out["mojibake"] = n(audit.MOJIBAKE)
    out["lig_bad"] = tokens_like(_plain(audit.OE_NOUNS + audit.OE_ONLY), True)
    out["lig_good"] = tokens_like(_plain([w.replace("oe", "œ") for w in audit.OE_NOUNS]), True)
    single = [w for w in audit.AFTER_A if "~" not in w]
    out["caps_bad"] = (
        tokens_like(_plain([w.translate(audit._PLAIN) for w in audit.ACCENTED]))
        + " + "
        + at(f"l[i] = 'A' and l[i + 1] = ' ' and (l[i + 2] in {among(single)} or (l[i + 2] = 'peu' and l[i + 3] = ' ' and l[i + 4] = 'près'))")
    )
    out["caps_good"] = tokens_like(_plain(audit.ACCENTED) + "|À")
    out["hyphen_residue"] = n(f"{LOW}- {LOW}")
    return out


def damaged_parts() -> str:
    return f"d as (select *, {parts()} as l from (select doc_id, source, lang, {damaged_sql()} as t from documents))"


def counters_by_book() -> str:
    sums = ", ".join(f"sum({sql})::bigint as {name}" for name, sql in text_counters().items())
    return f"with {damaged_parts()} select source, lang, count(*)::int as n_docs, {sums} from d group by source, lang"


def classified() -> str:
    """source, lang, cls, score, n_defects of the counters, which have no dialogue dashes."""
    rules_ = [
        ("not fr", "0", True),
        ("fr and chars > 30000 and apos * 10000.0::double / chars < 12", "120", True),
        ("mojibake >= 5 and mr > 0.05", "100 + mr * 10", True),
        ("hyphen_residue >= 20 and hr > 0.5", "60 + hr * 5", True),
        ("fr and apos > 50 and apos_straight / apos::double > 0.25", "40.0::double * apos_straight / greatest(apos, 1)", True),
        (
            "fr and marks > 30 and (punct_space + punct_none) / marks::double > 0.30",
            "35.0::double * (punct_space + punct_none) / greatest(marks, 1) + case when punct_none / marks::double > 0.5 then 15 else 0 end",
            True,
        ),
        ("fr and inner_ > 20 and (guil_in_space + guil_in_none) / inner_::double > 0.30", "10", True),
        ("fr and lig_bad > 3 and lig_bad > lig_good", "15", True),
        ("fr and dq_straight + dq_curly > 50 and dq_straight + dq_curly > guil_open + guil_close", "20", True),
        ("fr and ellipsis_dots > 20 and ellipsis_dots > ellipsis_char", "3", True),
        ("fr and caps_bad > 10 and caps_bad > caps_good", "3", True),
        ("fr and softhyphen > 200", "2", True),
    ]
    total = " + ".join(f"case when {c} then {p} else 0 end" for c, p, _ in rules_)
    defects = " + ".join(f"(case when {c} then 1 else 0 end)" for c, _, _ in rules_)
    return f"""
with b as ({counters_by_book()}),
r as (select *, lang like 'fr%' or lang in ('', 'und') as fr, apos_straight + apos_curly as apos, punct_nbsp + punct_space + punct_none as marks,
  guil_in_nbsp + guil_in_space + guil_in_none as inner_, case when chars > 0 then mojibake * 10000.0::double / chars else 0 end as mr,
  case when chars > 0 then hyphen_residue * 10000.0::double / chars else 0 end as hr from b),
s as (select *, ({total})::double as s, {defects} as nd from r)
select source, lang, case when chars < 2000 then 'ERR' when s >= 60 then 'A' when s >= 18 then 'B' when s >= 2 then 'C' else 'OK' end as cls,
  case when chars < 2000 then 900.0::double else round(s, 1) end as score, (case when chars < 2000 then 1 else nd end)::int as n_defects from s"""


def scored(rows: str, keys: str) -> str:
    """keys, cls, score, n_defects and heads (the first 12 characters of each defect) of audit records with all their fields."""
    french = lambda head: f"fr and {head}"
    rules_ = [
        ("not fr", "0", "'langue ' || lang_ || ' — critères FR non appliqués'"),
        (french("chars > 30000 and apos * 10000.0::double / chars < 12"), "120", "'élisions quasi absentes'"),
        ("mojibake >= 5 and mr > 0.05", "100 + mr * 10", "'mojibake ×' || mojibake || ' (encodage double-décodé)'"),
        ("encoding_issues > 0", "80", "'fichiers non-UTF8'"),
        ("hyphen_residue >= 20 and hr > 0.5", "60 + hr * 5", "'césures résiduelles'"),
        (french("apos > 50 and apos_straight / apos::double > 0.25"), "40.0::double * apos_straight / greatest(apos, 1)", "'apostrophes droites'"),
        (
            french("marks > 30 and (punct_space + punct_none) / marks::double > 0.30"),
            "35.0::double * (punct_space + punct_none) / greatest(marks, 1) + case when punct_none / marks::double > 0.5 then 15 else 0 end",
            "'insécables ponctuation'",
        ),
        (french("inner_ > 20 and (guil_in_space + guil_in_none) / inner_::double > 0.30"), "10", "'guillemets sans insécable'"),
        (french("dashes > 20 and dlg_hyphen / dashes::double > 0.30"), "30.0::double * dlg_hyphen / greatest(dashes, 1)", "'dialogues au trait'"),
        (french("lig_bad > 3 and lig_bad > lig_good"), "15", "'ligatures œ perdues'"),
        (french("dq_straight + dq_curly > 50 and dq_straight + dq_curly > guil_open + guil_close"), "20", "'guillemets anglais'"),
        (french("ellipsis_dots > 20 and ellipsis_dots > ellipsis_char"), "3", "'« ... » au lieu de'"),
        (french("caps_bad > 10 and caps_bad > caps_good"), "3", "'capitales non accentuées'"),
        (french("softhyphen > 200"), "2", "'soft hyphens ×' || softhyphen"),
    ]
    total = " + ".join(f"case when {c} then {p} else 0 end" for c, p, _ in rules_)
    heads = ", ".join(f"case when {c} then left({d}, 12) end" for c, _, d in rules_)
    return f"""
with x0 as ({rows}),
x1 as (select *, lower(coalesce(nullif(lang_opf, ''), nullif(lang_db, ''), '')) as lang_, apos_straight + apos_curly as apos, punct_nbsp + punct_space + punct_none as marks,
  guil_in_nbsp + guil_in_space + guil_in_none as inner_, dlg_hyphen + dlg_emdash + dlg_endash as dashes, case when chars > 0 then mojibake * 10000.0::double / chars else 0 end as mr,
  case when chars > 0 then hyphen_residue * 10000.0::double / chars else 0 end as hr from x0),
x2 as (select *, lang_ like 'fr%' or lang_ in ('', 'und') as fr, coalesce(error, '') <> '' as wrong, chars < 2000 as little, coalesce(fixed_layout, false) or n_images > n_docs * 3 as pictures from x1),
x3 as (select *, ({total})::double as s, list_filter([{heads}], lambda d: d is not null) as found from x2)
select {keys}, case when wrong then 'ERR' when little and pictures then 'IMG' when little then 'ERR' when s >= 60 then 'A' when s >= 18 then 'B' when s >= 2 then 'C' else 'OK' end as cls,
  case when wrong then 999.0::double when little and pictures then 0 when little then 900 else round(s, 1) end as score, (case when wrong or little then 1 else len(found) end)::int as n_defects,
  array_to_string(case when wrong then [left(error, 12)] when little and pictures then ['livre image '] when little then ['texte quasi '] else found end, '|') as heads from x3"""


def record_defaults(rows: str, lang: str) -> str:
    """Audit records of counters without a container."""
    return f"select *, {lang} as lang_db, '' as lang_opf, '' as error, false as fixed_layout, 0 as n_images, 0 as encoding_issues, 0 as dlg_hyphen, 0 as dlg_emdash, 0 as dlg_endash from ({rows})"


#: audit records made of two keys, so that each rule and class occurs on both sides of its threshold: column, expression that Spark and DuckDB read alike
GRID = {
    "chars": "(k * 7919 + c * 104729) % 80000", "apos_straight": "(k * 31 + c) % 150", "apos_curly": "(k * 17) % 260", "mojibake": "case when k % 8 = 0 then (k * 13) % 12 else 0 end",
    "encoding_issues": "case when k % 19 = 0 then 1 else 0 end", "hyphen_residue": "(k * 7 + c) % 26", "punct_nbsp": "(k * 11) % 90", "punct_space": "(k * 3 + c) % 25", "punct_none": "(k * 5) % 25",
    "guil_in_nbsp": "(k * 23) % 60", "guil_in_space": "k % 9", "guil_in_none": "c % 9", "dlg_emdash": "(k * 29) % 40", "dlg_endash": "k % 3", "dlg_hyphen": "(c * 3) % 20", "lig_bad": "(k * 2 + c) % 9",
    "lig_good": "(k * 37) % 8", "dq_straight": "c % 45", "dq_curly": "k % 20", "guil_open": "(k * 41) % 60", "guil_close": "(k * 43) % 60", "ellipsis_dots": "(k * 47) % 40", "ellipsis_char": "(c * 7) % 50",
    "caps_bad": "k % 21", "caps_good": "c % 22", "softhyphen": "(k * 53) % 320", "n_images": "(k * 3) % 50", "n_docs": "10", "fixed_layout": "k % 23 = 0",
    "lang_opf": "case k % 6 when 0 then 'fr' when 1 then 'fr-FR' when 2 then '' when 3 then 'und' when 4 then 'en' else 'FR' end", "lang_db": "case when c % 2 = 0 then 'fr' else 'de' end",
    "error": "case when k % 97 = 0 then 'BadZipFile: no container' else '' end",
}


def grid_rows() -> str:
    return "select k, " + ", ".join(f"{e} as {n_}" for n_, e in GRID.items()) + " from (select o_orderkey as k, o_custkey as c from orders)"


def windows(target: int, overlap: int, separator: str) -> str:
    """The greedy cut of documents, one paragraph at a time."""
    sep = f"{quoted(separator)}" if separator.strip() else f"chr({ord(separator)})"
    return f"""
with recursive d as (select doc_id, string_split(text, {sep}) as l from documents),
w(doc_id, i, k, has, some_, open, size, chunk) as (
  select doc_id, 0, 0, false, false, ''::varchar, 0::bigint, null::varchar from d
  union all
  select doc_id, i + 1, k + full_::int, true, full_ or some_ or {stripped('p')} <> '', case when full_ then '[…suite — contexte précédent : …' || right(joined, {overlap}) || ']' else joined end,
    case when full_ then 0 else size2 end, case when full_ then joined end
  from (select *, size2 >= {target} as full_ from (select w.doc_id, i, k, some_, l[i + 1] as p, case when has then open || {sep} || l[i + 1] else l[i + 1] end as joined, size + length(l[i + 1]) + 2 as size2
    from w join d on w.doc_id = d.doc_id where i < len(l)))),
e as (select doc_id, k, chunk from w where chunk is not null union all select w.doc_id, k + 1, open from w join d on w.doc_id = d.doc_id where i = len(l) and some_)
select doc_id, k::int as k, count(*) over (partition by doc_id)::int as of, chunk, length(chunk)::int as chars from e"""


# --- corrections ---------------------------------------------------------------------------------

FILLERS = 26


def proposals() -> str:
    """book, doc, ord, a (sought), b (put): corrections of each document that fit, repeat, are missing, too short, beyond the bounds, delete, differ in spaces, are too many or have no document."""
    spot = lambda at, n_: f"substring(t, {at}, {n_})"
    plain = f"replace({spot('3 * n // 4', 20)}, '{T.NBSP}', ' ')"
    made = [
        (0, spot("n // 2", 24), f"{spot('n // 2', 23)} || 'é'"), (1, f"{spot('n // 2', 23)} || 'é'", f"{spot('n // 2', 23)} || 'ée'"), (2, "'zzzzzzzz absent'", "'zzzzzzzz absents'"),
        (3, spot("n // 3", 5), "'autre'"), (4, spot("n // 4", 20), "repeat('long ', 9)"), (5, spot("n // 5", 30), spot("n // 5", 12)), (6, plain, f"{plain} || 's'"),
    ]
    rows = " union all ".join(f"select book, 'd' as doc, {o}::bigint as ord, {a} as a, {b} as b from x where n > 120" for o, a, b in made)
    more = f"select book, 'd', unnest(range(7, {7 + FILLERS})), 'zzzz ' || unnest(range(7, {7 + FILLERS})), 'zzzz s' from x where n > 3000"
    return f"""x as (select doc_id as book, replace(text, ' e', '{T.NBSP}e') as t, length(text) as n from documents where text is not null),
c as (select * from ({rows} union all {more} union all select book, 'absent', 99, 'zzzz orphan', 'zzzz orphans' from x where n > 120) where a <> b and a <> '')"""


def applied() -> str:
    """(book, budget, asked, the text after each correction t0 ..., status s0 ..., actual c0 ...) in the last table, z."""
    esc = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    flat = lambda t: f"replace(replace(replace({t}, '{T.NBSP}', ' '), '{T.NNBSP}', ' '), '{T.THIN}', ' ')"
    out = f"""with {proposals()},
g as (select book, t, n, greatest(25, floor({n(f'[^{BLANK}]+', "('<p>' || " + esc + " || '</p>')")} * 0.2::double / 100))::bigint as budget from x),
y as (select g.*, coalesce(asked, 0) as asked, coalesce(asked, 0) > budget as over_ from g left join (select book, count(*) as asked from c group by book) q using (book)),
p as (select book, {', '.join(f"max(a) filter (ord = {o}) as a{o}, max(b) filter (ord = {o}) as b{o}" for o in (0, 1, 5, 6))} from c where doc = 'd' group by book),
z_ as (select y.*, p.* exclude (book), t as z from y left join p using (book))"""
    at = "z_"
    for o in (0, 1, 5, 6):
        a, b, blank = f"a{o}", f"b{o}", BLANK
        words = f"abs({n(f'[^{blank}]+', b)} - {n(f'[^{blank}]+', a)})"
        limits = f"{words} > 6 or length({a}) - length({b}) > 60 or levenshtein({a}, {b}) > 30" if o == 5 else f"{words} > 2"
        exact = f"((length(z) - length(replace(z, {a}, ''))) // length({a}))"
        place = f"strpos({flat('z')}, {flat(a)})"
        out += f""",
m{o} as (select *, {exact} as e, {place} as at_ from {at}),
k{o} as (select * exclude (e, at_, z), z as old, at_, case when {a} is null then null when over_ then 'budget dépassé' when length({a}) < 8 then 'motif trop court' when {limits} then 'au-delà des bornes' when e > 1 then 'motif non unique' when e = 1 then ''
  when at_ = 0 then 'motif introuvable dans les segments texte' when strpos(substring({flat('z')}, at_ + 1), {flat(a)}) > 0 then 'motif non unique avec tolérance espaces' else ' ' end as r{o}, z from m{o}),
l{o} as (select * exclude (old, at_, z), case r{o} when '' then {a} when ' ' then substring(old, at_, length({a})) end as c{o},
  case r{o} when '' then replace(old, {a}, {b}) when ' ' then left(old, at_ - 1) || substring(old, at_, length({a})) || right({b}, length({b}) - length({a})) || substring(old, at_ + length({a})) else z end as z from k{o})"""
        at = f"l{o}"
    return out + f", z as (select *, '<p>' || {esc.replace('(t,', '(z,')} || '</p>' as fixed from {at})"


def outcomes() -> str:
    done = " union all ".join(f"select book, 'd' as doc, {o}::bigint as ord, trim(r{o}) = '' as ok, r{o} as reason, c{o} as actual from z where r{o} is not null" for o in (0, 1, 5, 6))
    other = f"""select c.book, doc, ord, false, case when over_ then 'budget dépassé' when length(a) < 8 then 'motif trop court' when ord = 4 then 'au-delà des bornes' else 'motif introuvable dans les segments texte' end, null
  from c join z using (book) where doc = 'd' and ord not in (0, 1, 5, 6)"""
    return f"{applied()} select book, doc, ord::int as ord, case when ok then 'applied' else 'rejected' end as status, case when not ok then reason end as reason, actual from ({done} union all {other})"


def ranking() -> str:
    return f"""
select *, row_number() over (order by case cls when 'A' then 0 when 'ERR' then 1 when 'B' then 2 when 'C' then 3 when 'IMG' then 4 else 5 end, score desc, source, lang)::int as place
from ({classified()})"""


def anomaly_counts() -> str:
    low2 = f"{LOW}{{2,}}"
    short = anomalies.SHORTENED.removeprefix(r"\b(?:").removesuffix(r")\.$")
    # a match takes the first letter of the next word, which then can't begin another
    det = lambda i: f"coalesce(l[{i}] in {among(anomalies.DETERMINERS)} and l[{i} + 1] in (', ', ' , ') and regexp_matches(l[{i} + 2], '^{LOW}'), false)"
    counts = {
        "min_apres_point": f"{n(rf'\. {LOW}')} - {n(rf'[.…]\. {LOW}')} - {n(rf'(?:^|[^{W}])(?:{short})\. {LOW}')}",
        "maj_apres_virgule": at(f"l[i] in {among(anomalies.STARTERS)} and l[i - 1] like '%, '"),
        "point_colle": f"{n(rf'{LOW}{{2}}\.{LOW}{{2}}')} - {n(rf'{LOW}{{2}}\.(?:fr|com|net|org)\b')}",
        "det_virgule": at(f"{det('i')} and (not {det('i - 2')} or ({det('i - 4')} and not {det('i - 6')}))"),
        "abrev_m": at(f"l[i] = 'M' and l[i + 1] = ' ' and regexp_matches(l[i + 2], '^[A-ZÀ-Ö]{LOW}')"),
        "quatre_points": n(r"\.{4,}"),
        "espace_avant_point": n(f"{LOW} [,.][ \n]"),
        "virgule_point": "len(list_filter(regexp_extract_all(t, '[,.][.,]'), lambda x: x <> '..'))",
        "cesure_residuelle": at(f"regexp_full_match(l[i], '{low2}') and l[i + 1] = '- ' and regexp_full_match(l[i + 2], '{low2}')"),
        "guillemet_desequilibre": f"({chars('«')} <> {chars('»')})::int",
    }
    each = " union all ".join(f"select source, lang, {quoted(k)} as type, sum({sql})::bigint as n from d group by source, lang" for k, sql in counts.items())
    return f"with {damaged_parts()} {each}"


def anomaly_rows(words: str, lexicon: str) -> str:
    """Records of damaged documents, with context, of the detectors whose places the parts of a text tell; words: unknown words (source, word)."""
    low2 = f"{LOW}{{2,}}"
    norm = lambda x: f"regexp_replace(replace(lower(nfc_normalize({x})), '’', {quoted(chr(39))}), {quoted(anomalies.ELIDED)}, '')"
    cut = lambda p: f"regexp_extract_all(t, {quoted(p)})"
    token, dots = anomalies.WORD, r"\.{4,}"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""
with {damaged_parts()},
f as (select source, doc_id, t, gaps, forms, unnest(range(1, len(forms) + 1)) as i from (select source, doc_id, t, string_split_regex(t, {quoted(token)}) as gaps, {cut(token)} as forms from d)),
u as (select f.source, doc_id, t, 'mot_inconnu' as type, forms[i] as extrait, ({size('gaps[:i]')} + {size('forms[:i - 1]')})::int as pos, null::varchar as suggestion from f join ({words}) w on w.source = f.source and w.word = {norm('forms[i]')}),
x as (select source, doc_id, t, l, unnest(list_filter(range(1, len(l) + 1), lambda i: coalesce(regexp_full_match(l[i], '{low2}') and l[i + 1] = '- ' and regexp_full_match(l[i + 2], '{low2}'), false))) as i from d),
c as (select source, doc_id, t, 'cesure_residuelle' as type, l[i] || '- ' || l[i + 2] as extrait, {size('l[:i - 1]')}::int as pos, case when {norm("l[i] || l[i + 2]")} in (select word from ({lexicon})) then l[i] || l[i + 2] end as suggestion from x),
m as (select source, doc_id, t, 'abrev_m' as type, 'M ' || regexp_extract(l[i + 2], '^[A-ZÀ-Ö]{LOW}+') as extrait, {size('l[:i - 1]')}::int as pos, 'M. ' || regexp_extract(l[i + 2], '^[A-ZÀ-Ö]{LOW}+') as suggestion
  from (select *, unnest(list_filter(range(1, len(l) + 1), lambda i: coalesce(l[i] = 'M' and l[i + 1] = ' ' and regexp_matches(l[i + 2], '^[A-ZÀ-Ö]{LOW}'), false))) as i from d)),
g as (select source, doc_id, t, 'guillemet_desequilibre' as type, '« ×' || {chars('«')} || ' vs » ×' || {chars('»')} as extrait, 0 as pos, null as suggestion from d where {chars('«')} <> {chars('»')}),
q as (select source, doc_id, t, 'quatre_points' as type, dots[i] as extrait, ({size('rest[:i]')} + {size('dots[:i - 1]')})::int as pos, '…' as suggestion
  from (select *, unnest(range(1, len(dots) + 1)) as i from (select *, {cut(dots)} as dots, string_split_regex(t, {quoted(dots)}) as rest from d))),
every_ as (select * from u union all select * from c union all select * from m union all select * from g union all select * from q),
n as (select *, row_number() over (partition by source, type order by doc_id, pos) as k from every_)
select source, doc_id, type, pos, case when type = 'guillemet_desequilibre' then '' else regexp_replace(substring(t, greatest(1, pos - {anomalies.CONTEXT} + 1), least(pos, {anomalies.CONTEXT})), '^[{BLANK}]+', '') end as avant, extrait,
  case when type = 'guillemet_desequilibre' then '' else regexp_replace(substring(t, pos + length(extrait) + 1, {anomalies.CONTEXT}), '[{BLANK}]+$', '') end as apres, suggestion from n where k <= {anomalies.PER_TYPE}"""


def doubled_words() -> str:
    """Runs of k equal small words are k / 2 doublings."""
    return f"""
with {damaged_parts()},
u as (select doc_id, source, lang, unnest(l) as x, unnest(range(1, len(l) + 1)) as i from d),
w as (select *, lag(x, 1) over o as sep, lag(x, 2) over o as prev from u window o as (partition by doc_id order by i)),
s as (select *, sum(case when sep = ' ' and prev = x then 0 else 1 end) over (partition by doc_id, i % 2 order by i) as run from w where regexp_full_match(x, '{LOW}{{2,}}') or true),
r as (select source, lang, doc_id, i % 2 as half, run, x, count(*) as k from s where regexp_full_match(x, '{LOW}{{2,}}') group by all)
select source, lang, coalesce(sum(k // 2) filter (x not in {among(anomalies.DOUBLED)}), 0)::bigint as n from r group by source, lang"""


def _between(pattern: str, by: str, t: str) -> str:
    """A replacement whose match must stand between other characters, done twice since those are consumed."""
    once = lambda x: f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return once(once(t))


def rule_steps(sp: str = T.NNBSP, wordlist: bool = False) -> dict:
    """By rule: SQL of a text to SQL of the text after it, and the characters whose number grows by one with each match."""
    edge, end = rf"(^|[^{W}])", rf"([^{W}]|$)"
    tail = rules._OE_TAIL.removeprefix("(").removesuffix(r")\b").replace(r"\w", f"[{W}]")
    head = "([cC]h?|[mM]an|[bBmMnNsSvV]|)"

    def ligatures(t: str) -> str:
        t = _between(f"{edge}{head}oe({tail}){end}", "\\1\\2œ\\3\\4", t)
        return _between(f"{edge}{head}O[eE]({tail}){end}", "\\1\\2Œ\\3\\4", t)

    def capitals(t: str) -> str:
        t = _between(f"{edge}E({'|'.join(rules.ACUTE).replace('(?:z)', 'z')}){end}", "\\1É\\2\\3", t)
        for a, b in (("E(tre|tes)", "Ê\\2"), ("(Ete)", "Été"), ("(Epee)", "Épée")):
            t = _between(f"{edge}{a}{end}", f"\\1{b}\\3", t)
        t = _between(f"{edge}Evenement(s?){end}", "\\1Événement\\2\\3", t)
        words = rules.A_BEFORE.replace("~", "§").replace(" ", "|").replace("§", " ")
        return _between(f"{edge}A( (?:{words})){end}", "\\1À\\2\\3", t) if wordlist else t

    def spaces(t: str) -> str:
        for pattern, by in (
            ("[ \\x{2009}]+([!?;:»])", f"{sp}\\1"),
            (f"([{L}0-9)»…’])([!?;])", f"\\1{sp}\\2"),
            (f"([{L})»])(:[{BLANK}])", f"\\1{sp}\\2"),
            ("«[ \\x{2009}]+", f"«{sp}"),
            (f"«([^{BLANK}])", f"«{sp}\\1"),
        ):
            t = removed(t, pattern, by)
        return _between(f"([^«{BLANK}])»", f"\\1{sp}»", t)

    return {
        "R1_apostrophes": (lambda t: _between(f"([{L}])'([{L}])", "\\1’\\2", t), "’"),
        "R2_ligatures": (ligatures, "œŒ"),
        "R5_ellipsis": (lambda t: _between(r"(^|[^.])\.\.\.([^.]|$)", "\\1…\\2", t), "…"),
        "R6_capitales": (capitals, "ÉÊÀ"),
        "R4_insecables": (spaces, sp),
    }


def fixed_text(t: str = "t", sp: str = T.NNBSP) -> str:
    for step, _ in rule_steps(sp).values():
        t = step(t)
    return t


def counted_rules(rows: str, keep: str, sp: str = T.NNBSP, wordlist: bool = False) -> tuple[str, str]:
    """(common table expressions that take the text t of the rows through the rules, name of the last: keep, t and a count for each rule)."""
    out, at = [], rows
    for k, (name, (step, marks)) in enumerate(rule_steps(sp, wordlist).items()):
        grown = " + ".join(f"{chars(c, 'n')} - {chars(c)}" for c in marks)
        earlier = "".join(f", {n}" for n in list(rule_steps())[:k])
        out.append(f"q{k} as (select {keep}, t, {step('t')} as n{earlier} from {at}), r{k} as (select {keep}, n as t{earlier}, ({grown})::bigint as {name} from q{k})")
        at = f"r{k}"
    return ", ".join(out), at


def fixed_pages(pairs: list[tuple[str, str]], sp: str, wordlist: bool = False, mojibake: bool = False, decided: bool = False) -> str:
    """page_id, status, fixed (md5) and the counts of the rules over pages with damage; decided: every second isolated A of a page is approved."""
    inline = among([*T.INLINE, "br"])
    oe = rules._OE_TAIL.removeprefix("(").removesuffix(r")\b").replace(r"\w", f"[{W}]")
    refused = rf"(?:^|[^{W}])(?:[cC]h?|[mM]an|[bBmMnNsSvV]|)Oe(?:{oe})(?:[^{W}]|$)|(?:^|[^{W}])(?:Ete|Epee|Evenements?)(?:[^{W}]|$)"
    rest = "replace(replace(t, 'Ã©', ''), 'Ã\u00a0', '')"
    better = f"case when t ~ 'Ã' and regexp_full_match({rest}, '[\\x00-\\x7F]*') then replace(replace(t, 'Ã©', 'é'), 'Ã\u00a0', 'à') else t end" if mojibake else "t"
    alone = f"l[{{i}}] = 'A' and l[{{i}} + 1] = ' ' and regexp_matches(coalesce(l[{{i}} + 2], ''), '^{LOW}')"
    picked = f"case when {alone.format(i='i')} and (base + len(list_filter(range(1, i), lambda j: {alone.format(i='j')}))) % 2 = 0 then 'À' else l[i] end"
    chosen = f"array_to_string(list_transform(range(1, len(l) + 1), lambda i: {picked}), '')" if decided else "t"
    ctes, last = counted_rules("v", "page_id, ord, fragment, plain, c3, ca, c7, odd", sp, wordlist)
    counts = ["R1_apostrophes", "R2_ligatures", "R4_insecables", "R5_ellipsis", "R6_capitales"]
    return f"""
with g as (select page_id, {damaged_sql('html', pairs)} as html from pages), {fragment_rows().replace('from pages', 'from g')},
e as (select *, fragment like '<!--%' as remark, fragment like '</%' as closing, not is_tag and not in_skip as plain from f),
h as (select *, case when is_tag and not remark and closing and name = 'p' then false when is_tag and not remark and not closing and name = 'p' then true
  when is_tag and not remark and not closing and name not in {inline} then false when plain and {stripped('fragment')} <> '' then false end as event from e),
p as (select *, coalesce(last_value(event ignore nulls) over (partition by page_id order by ord rows between unbounded preceding and 1 preceding), false) and plain as para, case when plain then {unescaped('fragment')} end as t0 from h),
s as (select *, case when para then regexp_replace(t0, '^([{BLANK}]*)-[ {T.NBSP}{T.NNBSP}{T.THIN}]+', '\\1—\u00a0') else t0 end as t from p),
a as (select *, {parts()} as l, (t <> t0)::int as c3 from s),
b as (select *, {at(alone.format(i='i'))} as alone from a),
c as (select *, coalesce(sum(alone) over (partition by page_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as base from b),
d as (select page_id, ord, fragment, plain, c3, base, alone, {chosen} as t from c),
u as (select *, {better} as better from d),
v as (select page_id, ord, fragment, plain, c3, {"(base + alone + 1) // 2 - (base + 1) // 2" if decided else "0"} as ca, (better <> t)::int as c7, regexp_matches(better, {quoted(refused)}) as odd, better as t from u),
{ctes},
w as (select page_id, string_agg(case when plain then replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') else fragment end, '' order by ord) as new, coalesce(bool_or(odd), false) and coalesce(sum(c7), 0) = 0 as bad,
  {', '.join(f"coalesce(sum({n_}), 0)::bigint as {n_}" for n_ in counts)}, coalesce(sum(c3), 0)::bigint as R3_dialogues, coalesce(sum(ca), 0)::bigint as R6_a_grave_llm, coalesce(sum(c7), 0)::bigint as R7_mojibake from {last} group by page_id)
select page_id, case when bad then 'rejected' when new = html then 'unchanged' else 'changed' end as status, md5(case when bad then html else new end) as fixed,
  {', '.join(f"case when bad then 0 else {n_} end::bigint as {n_}" for n_ in (*counts, 'R3_dialogues', 'R6_a_grave_llm', 'R7_mojibake'))} from w join g using (page_id)"""


def fixed_counts() -> str:
    """source and the totals of the text rules over damaged documents."""
    ctes, last = counted_rules("v", "source")
    return f"with v as (select source, {damaged_sql()} as t from documents), {ctes} select source, {', '.join(f'sum({r})::bigint as {r}' for r in rule_steps())} from {last} group by source"


ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def unescaped(t: str) -> str:
    for a, b in ENTITIES:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    return t


def removed(t: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({t}, {quoted(pattern)}, {quoted(by)}, 'g')"


HEAD, STYLE = r"(?is)<head\b.*?</head>", r"(?is)<style\b.*?</style>"


def stripped(t: str) -> str:
    return removed(t, f"^[{BLANK}]+|[{BLANK}]+$")


def projections() -> dict[str, str]:
    h = removed("html", HEAD)
    hs = removed(h, STYLE)
    lines = lambda t: stripped(removed(unescaped(removed(removed(t, "(?i)</p>", "\n\n"), "<[^>]+>")), "\n{3,}", "\n\n"))
    return {
        "audit": unescaped(removed(hs, "<[^>]+>")),
        "lexicon": f"replace(lower(nfc_normalize({unescaped(removed(h, '<[^>]+>', ' '))})), '’', '''')",
        "sample": lines(hs),
        "chapter": lines(h),
        "license": removed(h, "<[^>]+>", " "),
    }


def fragment_rows() -> str:
    """page_id, ord, fragment, is_tag, in_skip of all fragments of pages."""
    skipped = among(list(T.SKIPPED))
    return f"""
f0 as (select page_id, unnest(regexp_extract_all(html, '<[^>]+>|[^<]+')) as fragment, unnest(range(len(regexp_extract_all(html, '<[^>]+>|[^<]+')))) as ord from pages),
f1 as (select *, fragment like '<%' as is_tag, lower(regexp_extract(fragment, '^</?\\s*([0-9A-Za-z]+)', 1)) as name from f0),
f2 as (select *, sum(case when is_tag and name in {skipped} then case when fragment like '</%' then -1 else 1 end else 0 end) over (partition by page_id order by ord) as s from f1),
f as (select *, s - least(0, min(s) over (partition by page_id order by ord)) > 0 as in_skip from f2)"""


# --- boilerplate ------------------------------------------------------------------------------------

#: by page_id modulo their number: literal replacements in the page that make it a case of the boilerplate remover
BOILERPLATE = [
    [("<article>", "<article><p>*** START OF this Gutenberg work ***</p>")],
    [("</article>", "<p>End of the Project Gutenberg text</p></article>"), ("<p><b>", "<b>")],
    [("<article>", "<article><p>Produced by a team at ebooksgratuits, with care</p>")],
    [("<article>", "<article><p>The full Project Gutenberg licence</p>"), ("é", "e"), ("à", "a"), ("ç", "c"), ("è", "e"), ("ê", "e"), ("ù", "u"), ("<p><b>", "<b>")],
    [("<article>", "<article><div><p>*** START OF this Gutenberg work ***</p></div>"), ('<div class="ad">', '<div class="ad"><blockquote>'), ("</article>", "</blockquote></article>")],
    [("<article>", "<article><p>Produced by nobody in particular</p>")],
    [("<article>", "<article><p>*** START OF a Gutenberg text ***</p>"), ("</article>", "<h2>*** END OF it</h2></article>")],
]


def by_case(html: str, key: str, cases: list[list[tuple[str, str]]]) -> str:
    return f"case {key} % {len(cases)} " + " ".join(f"when {k} then {damaged_sql(html, pairs)}" for k, pairs in enumerate(cases)) + " end"


def stripped_pages() -> str:
    block = "|".join(boilerplate.BLOCKS)
    opens, closes = rf"<(?:{block})[\s>]", rf"</(?:{block})\s*>"
    upto = lambda t, p: f"length(regexp_extract({t}, {quoted(f'(?is)^(.*?)(?:{p})')}, 1))"
    through = lambda t, p: f"length(regexp_extract({t}, {quoted(f'(?is)^.*?(?:{p})')}, 0))"
    has = lambda t, p: f"regexp_matches({t}, {quoted(f'(?is){p}')})"
    before = lambda at: f"length(regexp_extract(left(m, {at}), {quoted(f'(?is)^(.*){opens}')}, 1))"
    body, credit = "<body[^>]*>", boilerplate.CREDIT.pattern.replace("{,", "{0,")
    begin, finish = boilerplate.BEGIN.pattern, boilerplate.FINISH.pattern
    last = "length(regexp_extract(m, '(?is)^(.*)</body>', 1))"
    surplus = lambda t: "[" + ", ".join(f"{n(f'(?i)<{b}[\\s>]', t)} - {n(f'(?i)</{b}\\s*>', t)}" for b in boilerplate.BLOCKS) + "]"
    plain = removed(removed("html", HEAD), "<[^>]+>", " ")
    return f"""
with h as (select page_id, {by_case('html', 'page_id', BOILERPLATE)} as html from pages),
a as (select *, html as m, {has(plain, boilerplate.LICENCE.removeprefix('(?i)'))} and {n(boilerplate.ACCENTS, plain)} < length({plain}) / 2000.0::double as licence from h),
b as (select *, {through('m', body)} as b, {last} as e, licence and {has('m', body)} and {has('m', '</body>')} and {last} > {through('m', body)} as whole from a),
c as (select page_id, html, whole, case when whole then left(m, b) || chr(10) || substring(m, e + 1) else m end as m, case when whole then e - b else 0 end as gone from b),
d as (select *, {upto('left(m, 6000)', credit)} as hs, {through('left(m, 6000)', credit)} as he, not whole and {has('left(m, 6000)', credit)} as hit from c),
e as (select *, {before('hs')} as x, he + {through('substring(m, he + 1)', closes)} as y, hit and {has('left(m, hs)', opens)} and {has('substring(m, he + 1)', closes)} as go from d),
f as (select page_id, html, whole, case when go then left(m, x) || chr(10) || substring(m, y + 1) else m end as m, gone + case when go then y - x else 0 end as gone from e),
g as (select *, {upto('m', begin)} as hs, {through('m', begin)} as he, {through('m', body)} as b, not whole and {has('m', begin)} and {has('m', body)} and {through('m', body)} < {upto('m', begin)} as go from f),
i as (select *, he + case when {has('substring(m, he + 1)', closes)} then {through('substring(m, he + 1)', closes)} else 0 end as y from g),
j as (select page_id, html, whole, case when go then left(m, b) || chr(10) || substring(m, y + 1) else m end as m, gone + case when go then y - b else 0 end as gone from i),
k as (select *, {upto('m', finish)} as hs, {last} as e, not whole and {has('m', finish)} as hit from j),
l as (select *, {before('hs')} as x, hit and {has('left(m, hs)', opens)} and e > hs as go from k),
o as (select page_id, html, case when go then left(m, x) || chr(10) || substring(m, e + 1) else m end as m, gone + case when go then e - x else 0 end as gone, contains(html, 'utenberg') as gate from l),
q as (select *, gate and gone > 0 and {surplus('html')} <> {surplus('m')} as drift from o),
r as (select page_id, gate, drift, case when drift or not gate then html else m end as stripped, case when drift or not gate then 0 else gone end as removed from q)
select page_id, removed::int as removed, drift, gate and not regexp_matches(case when {has('stripped', body + '.*</body>')} then regexp_extract(stripped, '(?is)<body[^>]*>(.*)</body>', 1) else stripped end, {quoted('(?i)' + opens)}) as dropped, md5(stripped) as stripped from r"""


PACKAGE = '<package><manifest><item id="a" href="t/a{0}.xhtml"/><item href=\'b{0}.xhtml\' id=\'b\'/><item id="c" href="c{0}.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>'
_POINT = '<navPoint id="{i}" playOrder="{o}"><content src="{src}" />{more}</navPoint>'
_NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{0}</navMap></ncx>'
_TARGETS = {"p": "t/a{0}.xhtml#top", "q": "b{0}.xhtml", "r": "c{0}.xhtml#gone", "s": "c{0}.xhtml#kept"}


def navigation(*points: str, first: int = 1) -> str:
    """A navigation of the points named, q under p, numbered from first on or all the same with 0."""
    order = {k: (i + first if first else 9) for i, k in enumerate(points)}
    made = lambda k, more="": _POINT.format(i=k, o=order[k], src=_TARGETS[k], more=more)
    return _NCX.format("".join(made(k, made("q") if k == "p" and "q" in points else "") for k in points if k != "q"))


def with_id(template: str) -> str:
    return "replace(" + quoted(template) + ", '{0}', page_id::varchar)"


def pruned_pages() -> str:
    """By page_id modulo 3: nothing dropped, a and b dropped, c dropped; the anchors top and kept survive, gone doesn't."""
    head = "<?xml version='1.0' encoding='utf-8'?>\n"
    a, b, c = ('<item id="a" href="t/a{0}.xhtml"/>', "<item href='b{0}.xhtml' id='b'/>", '<item id="c" href="c{0}.xhtml"/>')
    ref = '<itemref idref="{}"/>'
    less = lambda *gone: reduce(lambda t, x: t.replace(x, ""), gone, PACKAGE)
    opf = [PACKAGE, less(a, b, ref.format("a"), ref.format("b")), less(c, ref.format("c"))]
    ncx = [navigation("p", "q", "s"), navigation("s"), navigation("p", "q")]
    pick = lambda of: "case page_id % 3 " + " ".join(f"when {k} then {with_id(x)}" for k, x in enumerate(of)) + " end"
    return f"select page_id, {pick(opf)} as opf, {pick([head + x for x in ncx])} as ncx from pages"


#: by page_id modulo their number: the metadata of a package
METADATA = [
    '<package><metadata><dc:identifier id="i">http://x.org/{0}</dc:identifier><dc:title>Ancien</dc:title><dc:creator>Qui</dc:creator><dc:rights a="b">r\ns</dc:rights></metadata></package>',
    '<package><metadata xmlns:opf="u"><dc:identifier>urn:isbn:{0}</dc:identifier>\n \n\n<dc:contributor>Distributed Proofreaders</dc:contributor><dc:contributor>Une autre</dc:contributor></metadata></package>',
    '<package><metadata><dc:identifier>ebooksgratuits-{0}</dc:identifier><dc:publisher>Project Gutenberg</dc:publisher><dc:publisher>Autre</dc:publisher><dc:source>www.gutenberg.org/{0}</dc:source><dc:creator opf:role="aut">X</dc:creator></metadata></package>',
    "<package>{0}</package>",
]
NAVIGATION = '<ncx><head><meta name="dtb:uid" content="http://old/{0}"/><meta name="dtb:depth" content="{0}"/></head></ncx>'


def cleaned_pages(meta: boilerplate.Metadata) -> str:
    o = "case page_id % 4 " + " ".join(f"when {k} then {with_id(x)}" for k, x in enumerate(METADATA)) + " end"
    t = "o"
    steps = [(r"(?i)(<dc:identifier[^>]*>)(?:[^<]*(?:ebooksgratuits|gutenberg)[^<]*|https?:[^<]*)(</dc:identifier>)", rf"\1{meta.new_id()}\2"), *[(p, "") for p in boilerplate.UNWANTED], ("(<dc:creator[^>]*>)[^<]*(</dc:creator>)", rf"\1{meta.author}\2")]
    for pattern, by in steps:
        t = removed(t, pattern, by)
    element = lambda tag, value: f"case when not contains(t, '<dc:{tag}') then chr(10) || '  <dc:{tag}>{value}</dc:{tag}>' else '' end"
    add = f"chr(10) || '  <dc:rights>{boilerplate.RIGHTS}</dc:rights>' || chr(10) || '  <dc:contributor opf:role=\"edt\">{meta.note}</dc:contributor>' || {element('title', meta.title)} || {element('creator', meta.author)} || chr(10)"
    ns = "case when contains(t, '<metadata') and not contains(t, 'xmlns:opf') then replace(t, '<metadata', '<metadata xmlns:opf=\"http://www.idpf.org/2007/opf\"') else t end"
    return f"""
with a as (select page_id, {o} as o from pages), b as (select page_id, {t} as t from a), c as (select page_id, {ns} as u, {add} as add_ from b)
select page_id, regexp_replace(replace(u, '</metadata>', add_ || '</metadata>'), '\n[{BLANK}]*\n+', chr(10), 'g') as opf, replace({with_id(NAVIGATION)}, 'http://old/' || page_id, {quoted(meta.new_id())}) as ncx from c"""


# --- e-books -------------------------------------------------------------------------------------------

#: ten pages are a book; by book modulo 6: whole, of pictures, a broken container, no file, in Latin-1 with dialogues, in English
BOOK_CASES = 6
DASHED = [("<p>A", "<p>- A"), ("<p>T", "<p><i>— T"), (" of ", " d'un coeur! "), (" le ", " « le » ")]


def library_books() -> str:
    from_page = f"case when b % 6 = 1 then '<p>x</p>' when b % 6 = 4 then regexp_replace({damaged_sql('html', DASHED)}, '[^\\x00-\\xFF]', '?', 'g') else html end"
    counters = ", ".join(f"coalesce(sum({sql}), 0)::bigint as {k}" for k, sql in text_counters().items())
    dashes = rf"(?i)<p[^>]*>(?:[{BLANK}]|<[^>]+>|&(?:nbsp|#160|#xa0|#8239);)*({audit.DASH})"
    kinds = ", ".join(f"coalesce(sum(len(list_filter(dd, lambda x: x in {among(list(f))}))), 0)::bigint as {k}" for k, f in audit.DASHES.items())
    zero = ", ".join(f"case when error = '' then {k} else 0 end as {k}" for k in audit.COUNTERS)
    sound = lambda value, otherwise="0": f"case when error = '' then {value} else {otherwise} end"
    rows = f"""with p as (select page_id // 10 as b, page_id, html from pages), h as (select b, {from_page} as html from p),
t as (select b, html, {projections()['audit']} as t, list_transform(regexp_extract_all(html, {quoted(dashes)}, 1), lambda x: lower(x)) as dd from h),
d as (select *, {parts()} as l from t),
c as (select b, count(*)::int as n_pages, sum((b % 6 = 4 and regexp_matches(html, '[^\\x00-\\x7F]'))::int)::int as odd, {counters}, {kinds} from d group by b),
f as (select * exclude (n_pages, odd), case b % 6 when 2 then 'BadZipFile: File is not a zip file' when 3 then 'epub_not_found' else '' end as error, n_pages, odd from c)
select b as id, {zero}, error, {sound("case when b % 6 = 5 then 'en' else 'fr-FR' end", "''")} as lang_opf, 'fr' as lang_db, {sound('b % 6 = 1', 'false')} as fixed_layout, {sound('2')} as n_images,
  {sound('n_pages + 1')} as n_docs, {sound('odd')} as encoding_issues, {sound('1')} as n_css, {sound('1')} as n_fonts, {sound("'2.0'", "''")} as epub_version from f"""
    keys = "id, error, lang_opf, epub_version, n_docs, n_css, n_fonts, n_images, fixed_layout, encoding_issues, error = '' as has_ncx, error = '' as has_nav, " + ", ".join(audit.COUNTERS)
    inner = scored(rows, "* exclude (s, found)")
    return f"select {keys}, cls, score, n_defects, heads, row_number() over (order by case cls when 'A' then 0 when 'ERR' then 1 when 'B' then 2 when 'C' then 3 when 'IMG' then 4 else 5 end, score desc, id)::int as place from ({inner})"
