"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import cotrain, decontam, langid, licenses, maskedlm, mtree, neardup, queries, spiece, tokenstore, toxicity

WORD = re.compile(r"\w+")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r[0]: r[1] for r in table("documents").select("doc_id", "text").collect()}


def words(t):
    return WORD.findall((t or "").lower())


# --- 1 -----------------------------------------------------------------------------------------


def smith_waterman(doc, item):
    best = 0
    row = [0] * (len(doc) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row = new
        best = max(best, *row)
    return best / (2 * len(item))


def test_alignment_scores():
    rng = np.random.default_rng(1)
    for _ in range(60):
        doc, item = rng.integers(1, 6, rng.integers(1, 25)), rng.integers(1, 6, rng.integers(1, 12))
        got, begin, end = decontam.align(doc[None].astype(np.uint64), item[None].astype(np.uint64))
        assert got[0] / (2 * len(item)) == smith_waterman(doc.tolist(), item.tolist())
        assert 0 <= begin[0] <= end[0] <= len(doc)


def test_leaks_are_those_of_full_alignment(table, texts):
    """Both ways, over whole texts: what aligns well as a whole is found, and what is found aligns as well."""
    from quillspark.llm import kernel

    items = {r[0]: r[1] for r in table("benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(table("documents"), table("benchmark")).collect()}
    w = {i: kernel.Words([x]).hash for i, x in items.items()}
    found = 0
    for d, t in texts.items():
        doc = kernel.Words([t or ""]).hash
        for i, item in w.items():
            if (d, i) not in got and np.isin(item, doc).sum() < 0.5 * len(item):
                continue  # can't score 0.5
            full = decontam.align(doc[None], item[None])[0][0] / (2 * len(item)) if len(doc) else 0
            if (d, i) in got:
                assert decontam.MIN_SCORE <= got[d, i] <= full + 1e-6, (d, i)
                assert got[d, i] >= full - 0.1, (d, i)
                found += 1
            else:
                assert full < 0.6, (d, i, full)
    assert found == len(got) > 0


def test_long_items_and_ties(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"q{x}" for x in rng.integers(0, 50_000, 30_000))
    short = "alpha bravo charlie delta echo foxtrot"
    docs = spark.createDataFrame([(1, "noise " * 5 + long), (2, f"{short} gap {short}"), (3, "nothing of it")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.leaks(docs, spark.createDataFrame([(7, long), (8, short)], "item_id long, text string"), max_words=10_000).collect()}
    assert sorted(got) == [1, 2] and got[1]["score"] == 1.0 and (got[1]["first_word"], got[1]["end_word"]) == (5, 30_005)
    assert (got[2]["first_word"], got[2]["end_word"]) == (0, 6)  # of two equal copies the first


def test_edited_copies_are_found_and_clean_ones_left(spark):
    base = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()
    edited = base[:5] + ["zulu"] + base[6:11] + base[12:]
    noise = [" ".join(f"w{(i * 37 + j * 11) % 500}" for j in range(80)) for i in range(30)]
    docs = [(i, n) for i, n in enumerate(noise)] + [(100, noise[0] + " " + " ".join(edited) + " " + noise[1]), (101, " ".join(reversed(base)))]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(base))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(100, 7)] and 0.8 < got[0]["score"] < 1


# --- 2, 5: SQL ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    key = lambda f: sorted(map(tuple, f.astype(object).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_licences_by_counting(threshold):
    lines = ["Released under the MIT license", "licensed under CC BY 4.0 now", "All rights reserved.", "nothing here"] * 2
    text = "\n".join(lines)
    pairs = lambda t: set(zip(words(t), words(t)[1:]))
    want = set()
    for kind, parts in (("text", [text]), ("paragraph", text.split("\n\n")), ("line", text.split("\n"))):
        for k, p in enumerate(parts):
            for n, t in licenses.TEMPLATES.items():
                a, b = pairs(p), pairs(t)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                    want.add((kind, k, n))
    got = {(r[1], r[2], r[3]) for r in licenses.scan([text], licenses.Index(licenses.TEMPLATES), threshold)}
    assert got == want and want


def windows_by_counting(text, threshold):
    w, out = words(text), set()
    pairs = lambda x: set(zip(x, x[1:]))
    for n, x in licenses.TEMPLATES.items():
        b, wide, run = pairs(words(x)), len(words(x)), []
        for i in range(max(1, len(w) - wide + 1)):
            a = pairs(w[i : i + wide])
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= threshold:
                if run and i >= run[-1][1] + wide:
                    out.add((min(r[1] for r in run if r[0] == max(run)[0]), n))
                    run = []
                run.append((dice, i))
        if run:
            out.add((min(r[1] for r in run if r[0] == max(run)[0]), n))
    return out


def test_licences_wherever_they_stand(spark):
    full = licenses.TEMPLATES
    wrap = lambda s, n, end: end.join(" ".join(s.split()[i : i + n]) for i in range(0, len(s.split()), n))
    cases = {
        "mit-notice": "The data was gathered by hand over years. Released under the MIT License. Please write to the authors of it.",
        "gpl3-header": wrap(full["gpl3-header"], 9, "\n") + "\nimport os\n" + "\n".join(f"x{i} = call{i}(y{i})" for i in range(60)),
        "mit-grant": "Copyright of somebody\r\n\r\n" + wrap(full["mit-grant"], 9, "\r\n") + "\r\n\r\n" + " ".join(f"other{i}" for i in range(120)),
        "apache-header": full["apache-header"].replace(" http", "\n\n    http").replace("2.0 Unless", "2.0\n\nUnless") + "\n\n" + " ".join(f"code{i}" for i in range(120)),
    }
    index = licenses.Index(full)
    for threshold in (0.6, 0.75, 0.9):
        texts = [*cases.values(), "", "one", "MIT license", " ".join(cases.values()), full["isc-grant"] * 3, "of this software and the use of this software " * 20]
        got = [set() for _ in texts]
        for r in licenses.scan_windows(texts, index, threshold):
            got[r[0]].add((r[2], r[3]))
        assert got == [windows_by_counting(x, threshold) for x in texts]
    for n, x in cases.items():
        assert n not in {r[3] for r in licenses.scan([x], index, 0.75)} and n in {r[3] for r in licenses.scan_windows([x], index, 0.75)}
    df = spark.createDataFrame([(1, cases["mit-notice"]), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["kind"], r["segment"], r["licence"]) for r in licenses.find(df, windows=True).collect()] == [(1, "window", 8, "mit-notice")]
    assert licenses.find(df).count() == 0


def tree_holds(t):
    """Every node covers all that is below it, and every stored distance is that to the node above."""
    below = {k: list(range(t.first[k], t.last[k])) for k in t.leaves}
    for k in reversed(range(len(t.leaf))):
        if not t.leaf[k]:
            below[k] = [e for c in range(t.first[k], t.last[k]) for e in below[c]]
            assert all(t.above[c] == k and np.isclose(t.to_parent[c], np.linalg.norm(t.routing[c] - t.routing[k])) for c in range(t.first[k], t.last[k]))
        d = np.linalg.norm(t.vectors[below[k]] - t.routing[k], axis=1)
        assert d.max() <= t.radius[k] + 1e-5
        if t.leaf[k]:
            assert np.allclose(d, t.parent[below[k]], atol=1e-5)
    assert sorted(below[0]) == list(range(len(t.ids)))


def test_tree_has_inner_nodes_with_radii_and_parent_distances():
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.1, (3000, 5)) + 8 * rng.integers(0, 6, (3000, 1))
    t = mtree.build(np.arange(3000), v, 16, 4)
    tree_holds(t)
    assert mtree.depths(t).max() >= 3 and max(t.last[t.leaves] - t.first[t.leaves]) <= 16
    same = mtree.build(np.arange(500), np.ones((500, 3)), 16, 4)  # equal vectors
    tree_holds(same)
    assert max(same.last[same.leaves] - same.first[same.leaves]) <= 16


def test_search_skips_most_of_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.05, (4000, 6)) + 10 * rng.normal(size=(40, 6))[rng.integers(0, 40, 4000)]
    t, done, plain = mtree.build(np.arange(4000), v, 32, 8), [0], mtree.distances

    def counted(a, b):
        done[0] += len(a) * len(b)
        return plain(a, b)

    monkeypatch.setattr(mtree, "distances", counted)
    ids, d = mtree.search(t, np.arange(50), v[:50], 5)
    want = [sorted((round(float(np.sqrt(((v[i] - v[j]) ** 2).sum())), 9), j) for j in range(4000) if j != i)[:5] for i in range(50)]
    assert [list(zip(x.tolist(), y.tolist())) for x, y in zip(d, ids)] == want
    assert done[0] < 0.15 * 50 * 4000


@pytest.mark.parametrize("k,n,dim", [(1, 50, 3), (5, 400, 8), (20, 15, 4)])
def test_top_k_by_all_pairs(spark, k, n, dim):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(0, 1, (n, dim)) + 5 * rng.integers(0, 4, (n, 1)), 2)
    v[n // 2] = v[0]
    df = spark.createDataFrame([(i - 7, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    for every in (1, 3):
        got = mtree.top_k(df, k, every).collect()
        want = {(i - 7, r): j - 7 for i in range(n) if (i - 7) % every == 0 for r, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k], 1)}
        assert {(r["vec_id"], r["rank"]): r["neighbour"] for r in got} == want


def test_top_k_over_many_cells_and_parts(spark, monkeypatch):
    for name, value in (("PART", 40), ("PAGE", 8), ("FAN", 3), ("BLOCK", 30), ("SAMPLE", 200)):
        monkeypatch.setattr(mtree, name, value)
    test_top_k_by_all_pairs(spark, 4, 500, 6)
    hot = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(i, [float(i), 0.0]) for i in range(300, 320)], "vec_id long, embedding array<double>")
    got = mtree.top_k(hot, 3).collect()  # most vectors are one and the same
    assert {(r["vec_id"], r["rank"]): (r["neighbour"], r["distance"]) for r in got if r["vec_id"] == 100} == {(100, r): (r - 1, 0.0) for r in (1, 2, 3)}
    assert len(got) == 7 * 3


# --- 3 -------------------------------------------------------------------------------------------------


def test_store_round_trip(spark, table, texts, tmp_path):
    tokenstore.write_store(table("documents"), str(tmp_path))
    index = spark.read.parquet(f"{tmp_path}/index.parquet").collect()
    assert len(index) == len(texts)
    for r in index:
        ids = tokenstore.read_document(str(tmp_path), r.asDict())
        assert tokenstore.tokenizer().decode(ids) == texts[r["doc_id"]] and len(ids) == r["n_tokens"]
    with pytest.raises(ValueError):
        tokenstore.unpack(b"x", b"other", expected=index[0]["dict_hash"])


def test_dictionary_covers_all_parts(spark, monkeypatch):
    """Small dictionaries of all parts are merged in several rounds; what only the last documents hold is in the result."""
    for name, value in (("SAMPLES", 20_000), ("SMALL_BYTES", 4096), ("MERGED", 8)):
        monkeypatch.setattr(tokenstore, name, value)
    common = [(i, " ".join(f"the river number {i} runs {j} miles" for j in range(30))) for i in range(300)]
    late = [(300 + i, " ".join(f"quixotic zephyr {i} jumbled vortex {j}" for j in range(30))) for i in range(300)]
    rows = tokenstore.tokens(spark.createDataFrame(common + late, "doc_id long, text string").coalesce(1))
    d = tokenstore.fit(rows, 16_384)
    for text in (common[7][1][:200], late[7][1][:200]):
        raw = tokenstore.serialise(text, tokenstore.VOCABULARY)
        assert len(tokenstore._codec(d)[0].compress(raw)) < 0.9 * len(tokenstore._codec(b"")[0].compress(raw))


def test_dictionary_helps_short_documents():
    samples = [tokenstore.serialise(f"the cat number {i} sat on the mat of the house", tokenstore.VOCABULARY) for i in range(400)]
    d = tokenstore.train_dictionary(samples, 4096)
    assert len(tokenstore._codec(d)[0].compress(samples[7])) < len(tokenstore._codec(b"")[0].compress(samples[7]))


# --- 4, 10: held-out accuracy -------------------------------------------------------------------------------


def test_quality_on_labels_kept_out(spark):
    folder = "/root/testdata/sf0.01"
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    train = read("labels").filter("doc_id % 2 = 0")
    got = cotrain.score(read("documents"), read("pages"), train).join(read("labels").filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").collect()
    assert len(got) > 100
    for q, share in ((0, 0.6), (1, 0.95)):  # some twenty bad documents to learn from
        of = [r for r in got if r["quality"] == q]
        assert sum(r["keep"] == bool(q) for r in of) >= share * len(of)


def test_text_features_by_counting():
    texts = ["Ab c1!\nAb ab", "", "x x x", "é"]
    got = cotrain.text_features(texts)
    classes = [cotrain._classes()[ord(c)] for c in texts[0]]
    pairs = np.zeros((8, 8))
    for a, b in zip(classes, classes[1:]):
        pairs[a, b] += 1 / len(texts[0])
    assert np.allclose(got[0, :64].reshape(8, 8), pairs)
    for t, row in zip(texts, got):
        w = words(t)
        again = sum(a == b for a, b in zip(w, w[1:]))
        assert row[64] == np.log1p(len(t)) and row[65] == np.log1p(len(w)) and np.isclose(row[70], again / max(1, len(w)))
        assert np.isclose(row[68], len(set(w)) / max(1, len(w)))


def test_newton_step_is_that_of_all_rows_at_once(spark):
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(50, 3)), np.ones((50, 1))])
    y = (x[:, 0] + 0.3 * rng.normal(size=50) > 0).astype(int)
    parts = [cotrain._normal(x[a : a + 10], y[a : a + 10], np.full(10, 0.02), np.zeros(4)) for a in range(0, 50, 10)]
    whole = cotrain._normal(x, y, np.full(50, 0.02), np.zeros(4))
    assert np.allclose(sum(parts), whole)
    beta = np.zeros(4)
    for _ in range(8):
        beta = cotrain._step(beta, cotrain._normal(x, y, np.full(50, 0.02), beta), 1e-3)
    assert ((x @ beta > 0) == (y == 1)).mean() > 0.85


def test_language_on_documents_kept_out(spark, table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text", "lang").collect()]
    m = langid.fit_rows([r[1] for r in rows if r[0] % 2], [r[2] for r in rows if r[0] % 2])
    test = [r for r in rows if r[0] % 2 == 0 and len(r[1]) > 100]
    got = m.predict([r[1] for r in test])
    assert sum(g[1] == r[2] for g, r in zip(got, test)) >= 0.95 * len(test) and not any(g[3] for g in got)
    assert all(g[3] for g in m.predict(["продолжение следует вскоре", "これは日本語の文章です", "12345 !!", ""]))


def test_rare_languages_are_trained_on(spark):
    assert langid.quota([2, 500, 500], 52) == 25 and langid.quota([5, 5], 20) == 5 and langid.quota([9] * 10, 3) == 1
    rows = [(i, f"the house and the tree number {i}", "en") for i in range(500)] + [(500 + i, f"le chat et la maison {i}", "fr") for i in range(500)]
    rows += [(1000, "talossa on kissa ja koira", "fi"), (1001, "kissa nukkuu talossa", "fi")]
    rows += [(None, f"der hund und das haus {i}", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs, 60)
    assert {l for x in m.members for l in x} == {"de", "en", "fi", "fr"}
    assert [g[1] for g in m.predict(["talossa on kissa ja koira", "der hund und das haus 7"])] == ["fi", "de"]


# --- 6 -----------------------------------------------------------------------------------------------------


def test_pieces_are_those_of_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    hard = ["", " ", "  two  spaces ", "tab\tand\nline\n\n", "▁ itself ▁▁", "日本語 𝔘 é é", "a\u0000b", "😀 x", "\n"]
    sample = hard + list(texts.values())[:80]
    enc = spiece.Encoder()
    for part in (sample, sample[::-1]):
        e = enc.encode(part)
        for k, t in enumerate(part):
            lo, hi = e.first[k], e.first[k + 1]
            assert e.ids[lo:hi].tolist() == sp.encode(t), t[:40]
            data = t.encode()
            ends = e.ends[lo:hi].tolist()
            assert e.roundtrip[k] and e.starts[lo:hi].tolist() == [0, *ends[:-1]][: len(ends)] and (not ends or ends[-1] == len(data))
            for i, s, z in zip(e.ids[lo:hi].tolist(), e.starts[lo:hi].tolist(), ends):
                assert enc.surface[i].replace("▁".encode(), b" ").lstrip(b" ") in data[s:z] + b"\xe2\x96\x81" or "▁" in t
            assert enc.decode(e.ids[lo:hi].tolist()) == t.replace("▁", " ")


def test_character_map_longest_prefix_and_alignment():
    rules = {"ﬁ": "fi", "A": "a", "AB": "x", "ABC": "yz", "é": "e", "…": "..."}
    chars = spiece.CharsMap(spiece.compile_charsmap(rules))
    text = "ABAABC ﬁé…B"
    at, want, source = 0, "", []
    while at < len(text):
        key = max((k for k in rules if text.startswith(k, at)), key=len, default=None)
        new = rules[key] if key else text[at]
        want += new
        source += [len(text[:at].encode())] * len(new.encode())
        at += len(key or text[at])
    got, align = spiece.normalise(text, chars)
    assert got == want and align.tolist() == [*source, len(text.encode())]


def test_compatibility_map_is_that_of_unicode():
    import unicodedata

    walker = spiece.Walker(spiece.CharsMap(spiece.compatibility()))
    texts = ["plain", "", "ﬁn de l’été\u00a0!", "e\u0301te\u0301 ﷺ ㎏ ⑳ ｱｲ 𝔘𝔫𝔦", "\u1e69 s\u0323\u0307 …", "a\u200bb\ufeff", "tab\tand\nline", "½ ™ Å"]
    got, align = walker.normalise(texts)
    for t, g, a in zip(texts, got, align):
        assert g == unicodedata.normalize("NFKC", t.replace("\u200b", "").replace("\ufeff", "")), t
        assert (a is None) == (g == t) and (a is None or (len(a) == len(g.encode()) + 1 and a[-1] == len(t.encode()) and (np.diff(a) >= 0).all()))


@pytest.mark.parametrize("rules", [None, {"ﬁ": "fi", "A": "a", "AB": "x", "ABC": "yz", "é": "e", "…": "...", "\u200b": "", "n\u0303": "ñ"}])
def test_spans_through_the_map(rules):
    """Against an aligner that goes from character to character and from piece to piece."""
    blob = spiece.compatibility() if rules is None else spiece.compile_charsmap(rules)
    chars = spiece.CharsMap(blob)
    enc = spiece.Encoder(charsmap=blob)
    rng = np.random.default_rng(31)
    bag = ["A", "AB", "ABC", "é", "ﬁ", "…", " ", "  ", "n\u0303", "\u200b", "mañana", "the ", "cat", "日本", "\n", "e\u0301", "½", "x"]
    texts = ["", "…", "\u200b", "ABABC", "ﬁﬁ ﬁ"] + ["".join(rng.choice(bag, n)) for n in rng.integers(1, 25, 120)]
    e = enc.encode(texts)
    for k, t in enumerate(texts):
        data, at, plain, begin = t.encode(), 0, b"", []
        while at < len(data):  # the longest rule, character by character
            n, new = chars.longest(data, at)
            n, literal = (n, False) if n else (len(data[at:].decode()[0].encode()), True)
            new = data[at : at + n] if literal else new
            begin += range(at, at + n) if literal else [at] * len(new)
            plain += new
            at += n
        lo, hi = e.first[k], e.first[k + 1]
        ids = e.ids[lo:hi].tolist()
        assert enc.decode(ids) == plain.decode() and e.roundtrip[k]
        assert ids == enc.sp.encode("▁" + plain.decode().replace(" ", "▁")) if plain else not ids
        done, spans = 0, []
        for i in ids:
            width = len(enc.surface[i].replace("▁".encode(), b" "))
            width -= 1 if not spans and enc.surface[i].startswith("▁".encode()) else 0  # the dummy prefix
            s, z = done, done + width
            done = z
            if s == z:
                spans.append((begin[s] if s < len(begin) else len(data),) * 2)
            else:
                spans.append((begin[s], min((b for b in begin[z:] if b > begin[z - 1]), default=len(data))))
        assert list(zip(e.starts[lo:hi].tolist(), e.ends[lo:hi].tolist())) == spans, t


# --- 7 -----------------------------------------------------------------------------------------------------------


def run_back(t, symbols):
    return t.run(symbols[::-1])[::-1]


def test_composition_equals_one_after_the_other():
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.insult(), toxicity.threat()]
    whole = toxicity.grammar()
    rng = np.random.default_rng(2)
    every = ["".join(s) for n in range(1, 4) for s in itertools.product("OIMVTNRckqs", repeat=n)]
    every += ["".join(rng.choice(list("OIMVTNRckqsimv"), n)) for n in rng.integers(4, 14, 3000)]
    for s in every:
        step = s
        for p in parts:
            step = p.run(step)
        assert whole.run(s) == step


def naive_score(text, sets):
    """Rules stated over a list of words and marks, passage by passage, without any transducer."""
    total = 0.0
    marks = {**dict.fromkeys(",()[]–—…", "c"), ":": "k", **dict.fromkeys('«»“”"', "q"), **dict.fromkeys(".;!?", "s")}
    for line in re.split(r"[\n\r]", text.lower()):
        tokens = [(m[0], m.start()) for m in re.finditer(r"\w+|[,()\[\]–—…:«»“”\".;!?]", line)]
        passages, now = [], []
        for k, (x, at) in enumerate(tokens):
            now.append("".join("I" if x in sets[0] else "M" if x in sets[5] else "V" if x in sets[1] else "T" if x in sets[2] else "N" if x in sets[3] else "R" if x in sets[4] else marks.get(x, "O")))
            after = line[at + 1 : at + 2]
            if marks.get(x) == "s" and marks.get(after) not in ("q", "s"):
                passages.append(now)
                now = []
        for s in [*passages, now]:
            quoted = [False] * len(s)
            for i, x in enumerate(s):  # "...", he said
                if x == "R":
                    j, words_ = i - 1, 0
                    while j >= 0 and s[j] not in "qkR" and words_ < 3:
                        words_ += s[j] not in "cs"
                        j -= 1
                    if j >= 0 and s[j] == "q":
                        opening = max((q for q in range(j) if s[q] == "q"), default=-1)
                        for q in range(opening + 1, j):
                            quoted[q] = True
            state = 0
            for i, x in enumerate(s):  # he said: "..."
                if state == 0:
                    state = 1 if x == "R" else 0
                else:
                    quoted[i] = True
                    state = {("q", 1): 2, ("q", 2): 0}.get((x, state), state)
            hits = {}
            for i, x in enumerate(s):
                if x in "IMV":
                    back = []
                    for y in reversed(s[:i]):
                        if y in "ckqs" or len(back) == 2 or y in "IMV" or y == "N":
                            back.append(y)
                            break
                        back.append(y)
                    if len(back) <= 3 and "N" in back[:2]:
                        continue
                    hits[i] = "q" if quoted[i] else x
            for i, x in hits.items():
                if x == "q":
                    total += 0.1
                    continue
                reach = [y for y in s[max(0, i - 3) : i]]
                cut = max((k for k, y in enumerate(reach) if y in "ckqs"), default=-1)
                aimed = "T" in reach[cut + 1 :]
                after = []
                for j in range(i + 1, min(len(s), i + 3)):
                    if s[j] in "ckqs" or (j in hits and hits[j] != "q"):
                        break
                    after.append(s[j])
                late = "T" in after and not aimed
                total += {"I": 1.2 if aimed else 1.2 if late else 0.6, "M": 1.2 if aimed or late else 0.2, "V": 1.5 if aimed or late else 0}[x]
    return round(total, 6)


def test_scores_by_rules():
    sets = [set(x) for x in (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS, toxicity.MILD)]
    quoted = {
        'He said: "you are an idiot"': 0.1, '"You idiot," he said': 0.1, '"You idiot!" he said.': 0.1, "he said you idiot, you moron": 0.2, "dit: tu idiot": 0.1, "He wrote “I will kill you” to her": 0.1,
        'he said: "you idiot". you moron': 1.3, '"you are an idiot"': 1.2, "«Toi, imbécile», dit le roi": 0.1,
    }
    plain = {
        "you idiot": 1.2, "not an idiot": 0, "i will kill you. kill time": 1.5, "a clown and a jerk walked into a bar. the clown was stupid": 0.8, "you clown": 1.2, "clown you say": 1.2, "idiot, you": 0.6,
        "never stupid": 0, "": 0, "you are worthless and stupid": 1.4, "idiot idiot": 1.2, "kill the time": 0,
    }
    cases = quoted | plain
    lex, m = toxicity.lexicon(), toxicity.tables()
    got, _ = toxicity.score_texts(list(cases), lex, m)
    assert dict(zip(cases, got.tolist())) == cases
    assert [naive_score(c, sets) for c in cases] == got.tolist()
    rng = np.random.default_rng(12)
    bag = ["you", "idiot", "clown", "kill", "not", "said", "the", "cat", ",", ":", '"', "!", ". ", "\n", "moron", "he", "stupid"]
    texts = [" ".join(rng.choice(bag, n)).replace(' "', '"') for n in rng.integers(1, 14, 400)]
    got, _ = toxicity.score_texts(texts, lex, m)
    for t, g in zip(texts, got.tolist()):
        assert naive_score(t, sets) == pytest.approx(g), t


def test_stems_are_learned_from_labels_only(spark):
    bad = [f"word{i} zorgblat{'ing' * (i % 2)} thing{i * 7} every{i % 3}" for i in range(60)]
    good = [f"word{i} common{i % 5} thing{i * 3} every{i % 3}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(360)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, labels)
    from quillspark.llm import kernel

    found = {n: set(k.tolist()) for n, k in lex.stems.items()}
    assert found == {8: {int(kernel.hash_words(["zorgblat"])[0])}}
    assert toxicity.fit(docs, labels.limit(0)).stems == {} and toxicity.fit(docs, labels.filter("toxic = 1")).stems == {}


def test_clean_labelled_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").select("doc_id", labels.toxic.alias("bad")), "doc_id").collect()
    clean, bad = [r for r in got if not r["bad"]], [r for r in got if r["bad"]]
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean) and sum(r["toxic"] for r in bad) >= 0.6 * len(bad)


# --- 8 -------------------------------------------------------------------------------------------------------------


def jaccard_groups(texts, threshold):
    sets = {d: {tuple(words(t)[i : i + 3]) for i in range(max(1, len(words(t)) - 2))} if words(t) else {t.strip()} - {""} for d, t in texts.items() if t}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d: find(d) for d in sets if find(d) != d}


def test_near_duplicates_by_all_pairs(table, texts):
    got = {r["doc_id"]: r["duplicate_of"] for r in neardup.duplicates(table("documents")).collect()}
    want = jaccard_groups(texts, neardup.THRESHOLD)
    assert set(got) <= set(want)
    assert len(set(got.items()) & set(want.items())) >= 0.95 * len(want)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Texts that share a passage fill large buckets; those that are alike beyond it are found, whatever the way they are compared in."""
    rng = np.random.default_rng(21)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(60):
        own = " ".join(f"o{x}" for x in rng.integers(0, 100_000, 70))
        rows += [(10 * i, f"{passage} {own}"), (10 * i + 1, f"{passage} {own} extra{i} words{i}")][: 2 if i % 2 else 1]
    rows += [(10_000 + i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(0, 90, 9)]  # a chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_groups(dict(rows), neardup.THRESHOLD)
    got = []
    for paired in (0, 32, 10_000):
        monkeypatch.setattr(neardup._groups, "__defaults__", (paired,))
        got.append({r["doc_id"]: r["duplicate_of"] for r in neardup.duplicates(df, bands=60, rows=2).collect()})
    assert got[0] == got[1] == got[2] == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    one = a[:1]
    doc = np.repeat([0, 1, 2], [300, 300, 1])
    s = neardup.sketch(doc, np.concatenate([a, b, one]), 3, 1024)
    assert (s != ~np.uint64(0)).all()
    assert abs((s[0] == s[1]).mean() - 200 / 400) < 0.06


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60) if i != 30] + [(100, 101), (101, 100)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)} | {100: 100, 101: 100}


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_likelihood_token_by_token():
    rng = np.random.default_rng(5)
    net = maskedlm.Network.fresh(np.zeros(maskedlm.CLASSES))
    docs = [rng.integers(1, maskedlm.CLASSES, n).astype(np.uint8).tobytes() for n in (0, 1, 2, 7, 40)]
    got = maskedlm.score_ids(net, docs)
    for d, g in zip(docs, got):
        want = 0.0
        for i in range(len(d)):
            h = net.bias.astype(float).copy()
            for k, o in enumerate((-2, -1, 1, 2)):
                c = d[i + o] if 0 <= i + o < len(d) else 0
                h += net.embed[k * maskedlm.CLASSES + c]
            z = np.tanh(h) @ net.out + net.out_bias
            want += z[d[i]] - np.log(np.exp(z).sum())
        assert g == pytest.approx(want, abs=1e-3)


def test_gradient_lowers_the_loss_and_uses_both_sides():
    rng = np.random.default_rng(6)
    seq = [bytes([1 + (i + j) % 7 for j in range(50)]) for i in range(7)] * 20
    net = maskedlm.Network.fresh(np.zeros(maskedlm.CLASSES))
    flat, n = maskedlm.train_share(net, iter([seq] * 60))
    after = maskedlm.Network.of(flat)
    assert n == 60 * 140 * 50
    assert maskedlm.score_ids(after, seq[:7]).sum() > 0.2 * maskedlm.score_ids(net, seq[:7]).sum()
    left = [bytes([1, 2, 0, 4, 5])]
    p = after.log_probs(maskedlm.window_rows(*[maskedlm.layout(left)[0], np.array([4])]))[1][0]
    assert p.argmax() == 3 and rng is not None


def test_word_counts_cover_all_documents(table, texts):
    from collections import Counter

    want = Counter(w for t in texts.values() for w in words(t))
    got = sorted(r["c"] for r in maskedlm.count_words(table("documents")).collect())
    assert got == sorted(want.values())


def test_every_word_is_scored_by_its_own_count(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(maskedlm, "BLOCK", 5_000)  # several blocks in a partition
    rng = np.random.default_rng(8)
    lines = [[f"w{x}" for x in rng.integers(0, 40, 500)] for _ in range(1200)]
    lines[3] += ["onceqq", "twiceqq", "thriceqq", "thriceqq"]  # 1, 2 and 3 of 600,007 tokens in one suffix class
    lines[900] += ["twiceqq", "thriceqq"]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    blocks = maskedlm.cut(df)
    known = maskedlm.block_words(blocks)
    counts = maskedlm.total_counts(known)
    vocab = maskedlm.vocabulary(counts, maskedlm.Shape())
    got = {r["doc_id"]: r for r in maskedlm.tokens(blocks, known, counts, vocab).collect()}
    count, common = Counter(w for x in lines for w in x), {f"w{i}" for i in range(40)}
    mass = sum(n for w, n in count.items() if w not in common)
    assert mass == 6 and vocab.mass.sum() == sum(count.values())
    for i, x in enumerate(lines):
        assert got[i]["within"] == pytest.approx(sum(np.log(count[w] / mass) for w in x if w not in common), abs=1e-6) and got[i]["n"] == len(x)


def test_grouped_classes_token_by_token():
    rng = np.random.default_rng(9)
    shape = maskedlm.Shape(20, 4, 5, 16)
    net = maskedlm.Network.fresh(rng.normal(size=20), shape=shape)
    rows, target = rng.integers(0, 20, (4, 30)) + 20 * np.arange(4)[:, None], rng.integers(0, 20, 30)
    h, z = net.log_probs(rows)
    logp, dh, grads = net.of_targets(h, target, grad=True)
    assert np.allclose(np.exp(z).sum(1), 1, atol=1e-4) and np.allclose(logp, z[np.arange(30), target], atol=1e-4)
    for name, g in zip(("out", "out_bias", "group", "group_bias"), grads):
        x = getattr(net, name)
        for i in rng.integers(0, x.size, 5):
            at, old = np.unravel_index(i, x.shape), x.flat[i]
            loss = []
            for d in (0.01, -0.01):
                x[at] = old + d
                loss.append(-net.of_targets(h, target)[0].astype(float).mean())
            x[at] = old
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 0.02, abs=1e-3)


def test_classes_follow_the_corpus_and_rare_words_are_told_apart(spark):
    small, large = maskedlm.Shape.of(400_000), maskedlm.Shape.of(400_000_000)
    assert large.classes > 10 * small.classes and large.hidden > small.hidden
    rng = np.random.default_rng(10)
    rare = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}zz" for i in range(300)]  # one suffix, none is a frequent word
    frequent = [f"w{i}" for i in range(200)]
    lines = [[frequent[x] for x in rng.integers(0, 200, 60)] + [rare[i % 300], "w1", rare[(7 * i + 1) % 300], "w2"] for i in range(600)]
    lines += [[rare[i], "w5", "w6", "w7", rare[i + 1]] for i in range(0, 40, 2)] + [[rare[i + 1], "w5", "w6", "w7", rare[i]] for i in range(0, 40, 2)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["log_likelihood"] for r in maskedlm.score(df).collect()}
    assert sum(abs(got[600 + i] - got[620 + i]) > 1e-3 for i in range(20)) >= 12  # exchanged words of one suffix


# --- pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir, table, texts):
    """Every stage's decision again, document by document."""
    rows = [tuple(r) for r in table("documents").select("doc_id", "text", "lang").collect()]
    m = langid.fit_rows([r[1] for r in rows], [r[2] for r in rows])
    kept = {r[0] for r, g in zip(rows, m.predict([r[1] for r in rows])) if not g[3]}
    labels = {}
    for r in table("labels").collect():
        labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    rest = table("documents").filter(F.col("doc_id").isin(sorted(kept)))
    lex = toxicity.fit(rest, table("labels"))
    score = lambda t: toxicity.score_texts([t], lex, toxicity.tables())[0][0]
    kept = {d for d in kept if score(texts[d]) < toxicity.THRESHOLD}
    kept -= set(jaccard_groups({d: texts[d] for d in kept}, neardup.THRESHOLD))
    items = [words(r["text"]) for r in table("benchmark").collect()]
    has = lambda doc, x: any(doc[i : i + len(x)] == x for i in range(len(doc) - len(x) + 1))
    kept = {d for d in kept if not any(has(words(texts[d]), x) for x in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    missing, extra = kept - set(got), set(got) - kept
    assert not missing and len(extra) <= 0.02 * len(kept)  # a near-duplicate may escape the bands
    import unicodedata

    enc = spiece.Encoder()
    assert all(enc.decode(list(r["ids"])) == unicodedata.normalize("NFKC", texts[d]) and r["roundtrip"] for d, r in got.items())
