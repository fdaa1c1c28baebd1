"""License scan: Dice coefficient over word bigrams between segments of a text and licence templates.

A text is compared as a whole, paragraph by paragraph (parts between two line
feeds) and line by line.  A segment is the set of its pairs of neighbouring
words, lower-cased, punctuation dropped.  Dice >= t needs sizes a, b with
t/(2-t) <= a/b <= (2-t)/t; templates whose size is out of these bounds are
pruned before anything is counted, and so are segments without any bigram of
a template.  All segments of a chunk are compared side by side.

A notice that fills none of these (amid a line, wrapped before other text,
parted by empty lines, under CR LF) is found by windows of each template's
number of words, opened wherever enough bigrams of the template stand close.
They are rows of kind `window` beside the others, in a query of their own:
the SQL states the three segmentations only.

Defined results
    null or empty text, or under two words: no row.
    ties: each template that reaches the threshold gives a row.
    repeated rows: each gives its rows.  Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

THRESHOLD = 0.75

TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "reserved": "All rights reserved.",
}
SCHEMA = "doc_id long, kind string, segment long, licence string, common long, size long, template_size long, dice double"


class Index:
    """Bigrams of all templates: sorted hashes with the templates they are in."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        w = K.Words([templates[n] for n in self.names])
        at, h = w.grams(2)
        pairs = np.unique(np.stack([h, w.doc[at].astype(np.uint64)], 1), axis=0)
        self.size = np.bincount(pairs[:, 1].astype(np.int64), minlength=len(self.names))
        self.hash, first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(first, len(pairs))
        self.template = pairs[:, 1].astype(np.int64)
        self.words = np.diff(w.first)
        of = np.repeat(np.arange(len(self.hash)), np.diff(self.first))
        self.template_grams = [of[self.template == t] for t in range(len(self.names))]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.hash >> np.uint64(48)] = True


def segments(code: np.ndarray, c: K.Codes) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By kind, for each code point: the running number of its segment, and that of its text's first."""
    feed = code == 10
    line = np.cumsum(feed) - feed
    run = np.flatnonzero(np.diff(np.concatenate(([0], feed.view(np.int8), [0]))))
    sep = np.zeros(len(code), np.int64)
    text_end = np.zeros(len(code) + 1, bool)
    text_end[(c.first + c.length)[:-1]] = True
    for a, b in zip(run[::2], run[1::2]):
        if b - a == 1 and not text_end[a]:
            continue
        inside = 0
        for i in range(a, b):  # pairs of line feeds part paragraphs, the ends of texts part everything
            if text_end[i]:
                sep[i], inside = 1, 0
            else:
                inside += 1
                if inside == 2:
                    sep[i], inside = 1, 0
    para = np.cumsum(sep) - sep
    doc = np.repeat(np.arange(len(c.length)), c.length + 1)[: len(code)]
    return {"text": (doc, doc), "paragraph": (para, para[np.minimum(c.first, max(len(code) - 1, 0))][doc]), "line": (line, line[np.minimum(c.first, max(len(code) - 1, 0))][doc])}


def scan(texts: list[str], index: Index, threshold: float) -> Iterator[tuple[int, str, int, str, int, int, int, float]]:
    """(text's index, kind, segment, licence, common, size, template's size, Dice) of each pair that reaches the threshold."""
    w = K.Words(texts)
    if len(w.hash) < 2:
        return
    at, h = w.grams(2)
    maybe = np.flatnonzero(index.bits[h >> np.uint64(48)])
    gram = K.in_sorted(h[maybe], index.hash)
    maybe, gram = maybe[gram >= 0], gram[gram >= 0]
    if not len(maybe):
        return
    a, b = w.start[at], w.start[at + 1]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    for kind, (seg, base) in segments(w.codes.code, w.codes).items():
        one = seg[a] == seg[b]
        hit = one[maybe]
        hs, hg = seg[a[maybe[hit]]], gram[hit]
        if not len(hs):
            continue
        # the distinct bigrams of the segments that hold one of a template
        marked = np.unique(hs)
        of = np.flatnonzero(one)
        of = of[K.in_sorted(seg[a[of]], marked) >= 0]
        s, g = seg[a[of]], h[of]
        order = np.lexsort((g, s))
        s, g = s[order], g[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        size = np.bincount(np.searchsorted(marked, s[new]), minlength=len(marked))
        owner = w.doc[at[of]][order][new]
        place = base[a[of]][order][new]
        where = np.searchsorted(s[new], marked)
        pair = np.unique(np.stack([np.searchsorted(marked, hs), hg], 1), axis=0)
        n = index.first[pair[:, 1] + 1] - index.first[pair[:, 1]]
        rows = np.repeat(np.arange(len(pair)), n)
        t = index.template[np.repeat(index.first[pair[:, 1]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(rows))]
        m = pair[rows, 0]
        ratio = size[m] / index.size[t]
        fits = (ratio >= low - 1e-12) & (ratio <= high + 1e-12)
        key, common = np.unique(m[fits] * len(index.names) + t[fits], return_counts=True)
        for k, c in zip(key, common):
            i, t_ = divmod(int(k), len(index.names))
            dice = 2 * int(c) / int(size[i] + index.size[t_])
            if dice >= threshold:
                yield int(owner[where[i]]), kind, int(marked[i] - place[where[i]]), index.names[t_], int(c), int(size[i]), int(index.size[t_]), round(dice, 6)


def scan_windows(texts: list[str], index: Index, threshold: float) -> Iterator[tuple[int, str, int, str, int, int, int, float]]:
    """As scan(), for runs of as many words as the template has, wherever they stand; a shorter text is one run.

    Of overlapping runs that reach the threshold, from the first on as long as each overlaps the one before, the most alike is given,
    the first of such; segment is its first word's number in the text."""
    w = K.Words(texts)
    if len(w.hash) < 2:
        return
    at, h = w.grams(2)
    full = np.zeros(len(w.hash), np.uint64)
    full[at] = h
    maybe = at[index.bits[h >> np.uint64(48)]]
    gram = K.in_sorted(full[maybe], index.hash)
    maybe, gram = maybe[gram >= 0], gram[gram >= 0]
    n = index.first[gram + 1] - index.first[gram]
    rows = np.repeat(np.arange(len(gram)), n)
    template = index.template[np.repeat(index.first[gram] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(rows))] if len(rows) else np.zeros(0, np.int64)
    for t in np.unique(template).tolist():
        hits, wide, own = maybe[rows[template == t]], int(index.words[t]), int(index.size[t])
        # Dice >= threshold needs so many hits in a run
        k = max(1, int(np.ceil(threshold / (2 - threshold) * own - 1e-9)))
        if len(hits) < k:
            continue
        a, b = hits[: len(hits) - k + 1], hits[k - 1 :]
        near = (b - a <= wide - 2) & (w.doc[a] == w.doc[b])
        a, b = a[near], b[near]
        first, last = w.first[w.doc[a]], w.first[w.doc[a] + 1]
        lo, hi = np.maximum(first, b - (wide - 2)), np.minimum(a, np.maximum(first, last - wide))
        words, best, until, done = set(index.hash[index.template_grams[t]].tolist()), None, -1, -1
        for start, stop, d, end in zip(lo.tolist(), hi.tolist(), w.doc[a].tolist(), last.tolist()):
            for i in range(max(start, done + 1), stop + 1):
                done = i
                grams = set(full[i : min(i + wide, end) - 1].tolist())
                c = len(grams & words)
                dice = 2 * c / (len(grams) + own)
                if dice < threshold:
                    continue
                if best is not None and (i >= until or d != best[0]):
                    yield best
                    best = None
                if best is None or dice > exact:
                    best, exact = (d, "window", i - int(w.first[d]), index.names[t], c, len(grams), own, round(dice, 6)), dice
                until = i + wide
        if best is not None:
            yield best


def find(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """doc_id, kind, segment (from 0), licence, common, size, template_size, dice for each segment like a template; windows: and for each window."""
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, _, part in K.text_chunks(batch.column("text").to_pylist()):
                rows = list(scan(part, index.value, threshold))
                if windows:
                    rows += scan_windows(part, index.value, threshold)
                if rows:
                    cols = list(zip(*rows))
                    cols[0] = [ids[lo + d] for d in cols[0]]
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").mapInArrow(run, SCHEMA)


def sql(threshold: float = THRESHOLD) -> str:
    """The scan as DuckDB SQL over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted(TEMPLATES.items()))
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
with t as (select n as licence, {words.format('x')} as w from (values {values}) v(n, x)),
tb as (select licence, {bigrams} as b from t),
seg as (
  select doc_id, 'text' as kind, 0::bigint as segment, text as s from documents where text is not null
  union all select doc_id, 'paragraph', unnest(range(len(p)::bigint)), unnest(p) from (select doc_id, string_split(text, chr(10) || chr(10)) as p from documents where text is not null)
  union all select doc_id, 'line', unnest(range(len(p)::bigint)), unnest(p) from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null)),
sb as (select doc_id, kind, segment, {bigrams} as b from (select doc_id, kind, segment, {words.format('s')} as w from seg)),
c as (select doc_id, kind, segment, licence, len(list_intersect(sb.b, tb.b))::bigint as common, len(sb.b)::bigint as size, len(tb.b)::bigint as template_size
  from sb join tb on len(sb.b) > 0 and len(sb.b) >= len(tb.b) * {threshold} / (2 - {threshold}) - 1e-9 and len(sb.b) <= len(tb.b) * (2 - {threshold}) / {threshold} + 1e-9)
select *, round(2.0::double * common / (size + template_size), 6) as dice from c where 2.0::double * common / (size + template_size) >= {threshold}"""
