"""SentencePiece encoding with offsets, and decoding.

Normalisation is done here: at each position the longest prefix that the
compiled character map (a double-array trie over UTF-8 bytes) knows is
replaced, and for every byte of the result the source bytes it came from are
recorded.  The map is the model's own or, for a model that has none, one of
Unicode's compatibility composition compiled here (``compatibility``).  All
places of a chunk where a rule may begin walk the trie together.  White space is then escaped and the dummy prefix set as the model
says.  Pieces come from the library, run without any normalisation of its
own on units between which no merge can happen, each different unit once;
their byte spans are projected through the recorded alignment.

Every piece has a span of original UTF-8 bytes; a byte-fallback piece has that
of its byte (or of the rule's source, where a rule made it), the dummy prefix
an empty one.

Defined results
    null text: null ids, starts, ends, roundtrip.  Empty text: empty arrays, roundtrip true.
    unpaired surrogates can't occur in Spark strings.  Very long texts are encoded whole.
    repeated rows: each is encoded.  Extra columns: ignored.  Empty table: no row.
    characters that the map deletes: within the span of the piece before them.
    ``roundtrip`` says whether the decoded pieces give the normalised text; only a
    piece for unknown characters (models without byte fallback) can make it false.
"""

from __future__ import annotations

import os
import struct
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

MODEL = os.path.join(os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
SPACE = "▁"
CACHE_UNITS = 250_000
CHUNK = 1 << 18


# --- compiled character map -------------------------------------------------


class CharsMap:
    """A compiled map: size of the trie, the trie's units, the replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.pool = b""
        if len(blob) > 4:
            (n,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of data from `at`, and its replacement; (0, b"") where none is known."""
        u = self.units
        if not u:
            return 0, b""
        unit = u[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        best, value = 0, 0
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(u):
                break
            unit = u[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best, value = i - at + 1, u[node] & 0x7FFFFFFF
        return (best, self.pool[value : self.pool.index(0, value)]) if best else (0, b"")


def compile_charsmap(rules: dict[str, str]) -> bytes:
    """A compiled map of the rules: the trie's nodes are laid out level by level, each at the first base where its children fit."""
    pool, root = bytearray(), {}
    for k, v in sorted(rules.items()):
        node = root
        for c in k.encode():
            node = node.setdefault(c, {})
        node[-1] = len(pool)
        pool += v.encode() + b"\0"
    units: dict[int, int] = {}
    taken, bases = {0}, set()
    cursor, queue = 1, [(root, 0)] if root else []
    for node, at in queue:  # grows
        labels = [0 if c < 0 else c for c in node]
        tries, base = 0, cursor
        while base in bases or any(base ^ c in taken for c in labels):
            base += 1
            tries += 1
        if tries > 2000:  # what lies before is all but full
            cursor = base - 1000
        bases.add(base)
        taken.update(base ^ c for c in labels)
        units[at] = units.get(at, 0) | ((base ^ at) << 10) | (256 if -1 in node else 0)
        for c, child in node.items():
            if c < 0:
                units[base] = 0x80000000 | child
            else:
                units[base ^ c] = c
                queue.append((child, base ^ c))
    size = (max(units, default=0) | 255) + 1
    if size > 1 << 21:
        raise ValueError("too many rules for a compiled map")
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + bytes(pool)


@lru_cache(maxsize=1)
def compatibility() -> bytes:
    """The compiled map of Unicode's compatibility composition (NFKC): characters that it replaces, pairs that it composes; zero-width spaces go, line feeds and tabs stay."""
    rules: dict[str, str] = {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i <= 0xDFFF or 0xAC00 <= i <= 0xD7A3 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        n = unicodedata.normalize("NFKC", c)
        if n != c:
            rules[c] = n
        d = unicodedata.normalize("NFD", c)
        pair = unicodedata.decomposition(c)
        if n == c and len(d) > 1 and pair and not pair.startswith("<"):
            rules[d] = c
            two = "".join(chr(int(x, 16)) for x in pair.split())
            if len(two) > 1:
                rules[two] = c
    for c in "\u200b\ufeff":
        rules[c] = ""
    return compile_charsmap(rules)


class Walker:
    """A compiled map over many texts at once."""

    def __init__(self, chars: CharsMap):
        self.units = np.array(chars.units, np.uint32)
        self.pool = np.frombuffer(chars.pool, np.uint8)
        self.zero = np.flatnonzero(self.pool == 0)
        # which code points are rules by themselves, begin longer ones, come second in them
        self.alone, self.begins, self.second = (np.zeros(K.LIMIT + 1, bool) for _ in range(3))
        stack = [(b"", 0)]
        while stack:
            prefix, node = stack.pop()
            unit = chars.units[node]
            base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
            if unit >> 8 & 1 and prefix:
                key = prefix.decode()
                head = min(ord(key[0]), K.LIMIT)
                if len(key) == 1:
                    self.alone[head] = True
                else:
                    self.begins[head] = True
                    self.second[min(ord(key[1]), K.LIMIT)] = True
            for c in range(1, 256):
                if base ^ c < len(chars.units) and chars.units[base ^ c] & 0x800000FF == c and base ^ c != 0:
                    stack.append((prefix + bytes([c]), base ^ c))

    def matches(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest rule from each place, before its stop, and where its replacement begins; 0 for none."""
        u = self.units
        step = lambda unit: (unit >> np.uint32(10)) << ((unit & np.uint32(512)) >> np.uint32(6))
        best, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        node = np.full(len(at), step(u[:1])[0], np.uint32)
        live, i = np.arange(len(at)), 0
        while len(live):
            live = live[at[live] + i < stop[live]]
            c = data[at[live] + i].astype(np.uint32)
            n = node[live] ^ c
            ok = n < len(u)
            unit = u[np.where(ok, n, 0)]
            ok &= (unit & np.uint32(0x800000FF)) == c
            live, n, unit = live[ok], n[ok], unit[ok]
            n ^= step(unit)
            node[live] = n
            leaf = (unit >> np.uint32(8) & np.uint32(1)) == 1
            best[live[leaf]] = i + 1
            value[live[leaf]] = u[n[leaf]] & np.uint32(0x7FFFFFFF)
            i += 1
        return best, value

    def normalise(self, texts: list[str]) -> tuple[list[str], list[np.ndarray | None]]:
        """Each text after the map, and its alignment as ``normalise`` gives it, None where nothing changed."""
        c = K.Codes(texts)
        code = c.clipped()
        if not len(code) or not len(self.units):
            return texts, [None] * len(texts)
        maybe = self.alone[code]
        maybe[:-1] |= self.begins[code[:-1]] & self.second[code[1:]]
        places = np.flatnonzero(maybe)
        if not len(places):
            return texts, [None] * len(texts)
        data = np.frombuffer(c.text.encode(), np.uint8)
        size = 1 + (c.code >= 0x80).astype(np.int64) + (c.code >= 0x800) + (c.code >= 0x10000)
        begin = np.append(0, np.cumsum(size))
        text_at, text_end = begin[c.first], begin[c.first + c.length]
        of = np.searchsorted(c.first, places, "right") - 1
        at = begin[places]
        n, value = self.matches(data, at, text_end[of])
        hit = n > 0
        at, n, value = at[hit], n[hit], value[hit]
        if (at[1:] < at[:-1] + n[:-1]).any():  # a rule that begins within another's match doesn't count
            keep, free = np.ones(len(at), bool), 0
            for k, (a, m) in enumerate(zip(at.tolist(), n.tolist())):
                keep[k] = a >= free
                free = a + m if a >= free else free
            at, n, value = at[keep], n[keep], value[keep]
        length = self.zero[np.searchsorted(self.zero, value)] - value
        out = np.ones(len(data), np.int64)
        inner = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[inner] = 0
        out[at] = length
        align = np.repeat(np.arange(len(data)), out)
        made = data[align].copy()
        to = np.cumsum(out) - out
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        made[np.repeat(to[at], length) + within] = self.pool[np.repeat(value, length) + within]
        to = np.append(to, len(align))
        changed = np.zeros(len(texts), bool)
        changed[np.searchsorted(text_at, at, "right") - 1] = True
        plain, aligned = list(texts), [None] * len(texts)
        for d in np.flatnonzero(changed).tolist():
            a, b = to[text_at[d]], to[text_end[d]]
            plain[d] = made[a:b].tobytes().decode()
            aligned[d] = np.append(align[a:b], text_end[d]) - text_at[d]
        return plain, aligned


def normalise(text: str, chars: CharsMap, remove_extra: bool = False) -> tuple[str, np.ndarray]:
    """The text after the map (white space not yet escaped), and for each of its bytes and its end the source byte it began at."""
    data = text.encode()
    if not chars.units and not remove_extra:
        return text, np.arange(len(data) + 1)
    out, align, at = bytearray(), [], 0
    while at < len(data):
        n, new = chars.longest(data, at)
        if not n:
            c = data[at]
            n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            new = data[at : at + n]
            align.extend(range(at, at + n))
        else:
            align.extend([at] * len(new))
        out += new
        at += n
    align.append(len(data))
    if remove_extra:
        keep, seen = [], True
        for i, c in enumerate(out):
            if c != 32 or not seen:
                keep.append(i)
            seen = c == 32
        while keep and out[keep[-1]] == 32:
            keep.pop()
        end = align[keep[-1] + 1] if keep else len(data)
        out, align = bytearray(out[i] for i in keep), [align[i] for i in keep] + [end]
    return out.decode(), np.array(align, np.int64)


# --- encoder ------------------------------------------------------------------


@dataclass
class Encoded:
    """Pieces of a run of texts, flat, with the offsets of each text's first."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    roundtrip: np.ndarray


class Encoder:
    def __init__(self, model: str = MODEL, proto: bytes | None = None, charsmap: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        if proto is None:
            with open(model, "rb") as f:
                proto = f.read()
        m.ParseFromString(proto)
        spec = m.normalizer_spec
        self.chars = CharsMap(spec.precompiled_charsmap or charsmap or b"")
        self.walker = Walker(self.chars) if self.chars.units else None
        self.dummy, self.remove_extra, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        spec.precompiled_charsmap = b""
        spec.name = "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        self.surface: list[bytes] = []
        for p in m.pieces:
            self.surface.append(bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else p.piece.encode() if p.type != 3 else b"")
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        # units may be parted before a space only if no piece has one inside, and around a line feed if no piece has one
        inner = [p.piece for p in m.pieces if SPACE in p.piece.lstrip(SPACE)]
        self.split_spaces = not inner and self.escape
        self.split_lines = not any("\n" in p.piece for p in m.pieces)
        self.len = np.array([len(s) for s in self.surface], np.int64)
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.at = np.cumsum(self.len) - self.len
        self.spaces = np.array([s.count(SPACE.encode()) for s in self.surface], np.int64)
        self._reset()

    def _reset(self) -> None:
        """Empties the cache: rows of pieces and of their sizes, laid end to end."""
        self.index: dict[int, int] = {}
        self.flat, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.base, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, keys: list[int], units: list[str]) -> None:
        got = self.sp.encode(units, num_threads=1)
        count = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(count.sum()))
        size = self.len[ids]
        base = np.cumsum(count) - count
        bytes_ = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        odd = np.add.reduceat(np.append(size, 0), base) != bytes_
        for i in np.flatnonzero(odd | np.isin(np.arange(len(units)), np.searchsorted(base, np.flatnonzero(ids == self.unknown), "right") - 1)):
            size[base[i] : base[i] + count[i]] = self._measured(units[i], ids[base[i] : base[i] + count[i]])
        n = len(self.index)
        while len(self.flat) < self.used + len(ids):
            self.flat, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.flat, self.sizes))
        while len(self.base) < n + len(units):
            self.base, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.base, self.counts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[self.used : self.used + len(ids)] = size
        self.base[n : n + len(units)] = base + self.used
        self.counts[n : n + len(units)] = count
        self.used += len(ids)
        self.index.update(zip(keys, range(n, n + len(units))))

    def _measured(self, unit: str, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each piece covers where surfaces don't tell (unknown characters)."""
        proto = self.sp.encode(unit, out_type="immutable_proto")
        b = unit.encode()
        ends = [len(b) if p.end == len(unit) else len(unit[: p.end].encode()) for p in proto.pieces]
        return np.diff(np.array([0, *ends], np.int64))[: len(ids)]

    def encode(self, texts: list[str]) -> Encoded:
        if len(self.index) > CACHE_UNITS:
            self._reset()
        if self.remove_extra:
            plain, align = zip(*(normalise(t, self.chars, True) for t in texts)) if texts else ([], [])
        else:
            plain, align = self.walker.normalise(texts) if self.walker else (texts, [None] * len(texts))
        c = K.Codes(plain)
        code = c.code
        nbytes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        begin = np.zeros(len(code) + 1, np.int64)
        np.cumsum(nbytes, out=begin[1:])
        full = np.flatnonzero(c.length)
        head = c.first[full]
        cut = np.zeros(len(code) + 1, bool)
        cut[head] = True
        cut[c.first + c.length] = True
        # a unit ends before the line feed that parts two texts
        if self.split_spaces:
            space = (code == 32) | (code == 0x2581)
            cut[1:-1] |= space[1:] & ~space[:-1]
        if self.split_lines:
            line = code == 10
            cut[:-1] |= line
            cut[1:] |= line
        edges = np.flatnonzero(cut)
        starts, stops = edges[:-1], edges[1:]
        gap = np.zeros(len(code) + 1, bool)
        gap[(c.first + c.length)[:-1]] = True
        real = ~gap[starts] if len(starts) else np.zeros(0, bool)
        starts, stops = starts[real], stops[real]
        lead = np.zeros(len(code) + 1, bool)
        lead[head] = self.dummy
        lead_u = lead[starts]
        pw, ipw = K.powers(len(code) + 1)
        mixed = K.mix(code.astype(np.uint64))
        pre = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mixed * pw[: len(code)], out=pre[1:])
        h = K.mix((pre[stops] - pre[starts]) * ipw[starts] + (stops - starts).astype(np.uint64) + lead_u.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
        uniq, where, inv = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.index]
        if new:
            esc = (lambda s: s.replace(" ", SPACE)) if self.escape else (lambda s: s)
            units = [(SPACE if lead_u[j] else "") + esc(c.text[starts[j] : stops[j]]) for j in where[new]]
            self._learn([keys[i] for i in new], units)
        row = np.fromiter((self.index[k] for k in keys), np.int64, len(keys))[inv]
        per = self.counts[row]
        total = int(per.sum())
        off = np.cumsum(per) - per
        take = np.repeat(self.base[row] - off, per) + np.arange(total)
        ids, width = self.flat[take], self.sizes[take]
        doc_u = np.searchsorted(c.first, starts, "right") - 1
        # an escaped space is three bytes in the piece and one in the text
        doc = np.repeat(doc_u, per)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        decoded = self._flatten(ids)
        ok = self._same(decoded, ids, c, first)
        lead_piece = np.zeros(total, bool)
        lead_piece[off[lead_u & (per > 0)]] = True
        if self.escape:
            width = width - len(SPACE.encode()) * lead_piece
            if (code == 0x2581).any():  # an escape may stand for itself: by the text's own bytes
                end = self._source_ends(code, nbytes, c, width, first)
            else:  # an escaped space is three bytes in the piece and one in the text
                end = np.cumsum(width - 2 * (self.spaces[ids] - lead_piece))
        else:
            end = np.cumsum(width - lead_piece)
        before = np.append(0, end)[first[:-1]]
        end = end - np.repeat(before, np.diff(first))
        start = np.append(0, end[:-1]) if total else end
        start[first[:-1][np.diff(first) > 0]] = 0
        for d, a in enumerate(align):
            if a is not None:
                lo, hi = first[d], first[d + 1]
                s, e = start[lo:hi].copy(), end[lo:hi].copy()
                start[lo:hi] = a[s]
                # a span ends where the source of the next byte begins; within one rule's result it is the rule's end
                nxt = np.append(a[1:], a[-1])
                stop = nxt[np.maximum(e - 1, 0)]
                inside = (e > s) & (stop <= a[np.maximum(e - 1, 0)])
                if inside.any():
                    later = np.searchsorted(a, a[np.maximum(e - 1, 0)], "right")
                    stop = np.where(inside, a[np.minimum(later, len(a) - 1)], stop)
                end[lo:hi] = np.where(e > s, stop, a[s])
        return Encoded(ids, start.astype(np.int32), end.astype(np.int32), first, ok)

    def _source_ends(self, code: np.ndarray, nbytes: np.ndarray, c: K.Codes, width: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Running sum of source bytes at each piece's end, by walking escaped bytes and source bytes together."""
        inside = np.ones(len(code), bool)
        inside[(c.first + c.length)[:-1]] = False
        nb, esc = nbytes[inside], np.where(code == 32, 3, nbytes)[inside]
        eb = np.cumsum(esc)
        k = np.repeat(np.arange(len(nb)), esc)
        within = np.arange(len(k)) - (eb - esc)[k] + 1
        source = (np.cumsum(nb) - nb)[k] + np.where((code[inside] == 32)[k], 1, np.minimum(within, nb[k]))
        return np.append(0, source)[np.cumsum(width)]

    def _flatten(self, ids: np.ndarray) -> np.ndarray:
        n = self.len[ids]
        off = np.cumsum(n) - n
        return self.bytes[np.repeat(self.at[ids] - off, n) + np.arange(int(n.sum()))] if len(ids) else np.zeros(0, np.uint8)

    def _same(self, decoded: np.ndarray, ids: np.ndarray, c: K.Codes, first: np.ndarray) -> np.ndarray:
        """Whether each text's decoded bytes are its escaped bytes."""
        n = np.append(0, np.cumsum(self.len[ids]))[first]
        out = np.zeros(len(first) - 1, bool)
        raw = decoded.tobytes()
        for d in range(len(out)):
            text = c.text[c.first[d] : c.first[d] + c.length[d]]
            if self.escape:
                text = text.replace(" ", SPACE)
            want = ((SPACE if self.dummy and text else "") + text).encode()
            out[d] = raw[n[d] : n[d + 1]] == want
        return out

    def decode(self, ids: list[int]) -> str:
        """The normalised text of the pieces, without dummy prefix and escapes."""
        text = b"".join(self.surface[i] for i in ids).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


_encoders: dict[tuple, Encoder] = {}


def encoder(model: str = MODEL, charsmap: bytes | None = None) -> Encoder:
    """The process's encoder of a model file and map."""
    key = model, charsmap
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, charsmap=charsmap)
    return _encoders[key]


def encode(docs: DataFrame, model: str = MODEL, normal: bool = True) -> DataFrame:
    """doc_id, ids, starts, ends, roundtrip for each row of docs (doc_id, text); normal: a model without a map gets that of compatibility()."""
    shared = docs.sparkSession.sparkContext.broadcast(compatibility() if normal else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, shared.value)
        for batch in batches:
            col = batch.column("text")
            texts = col.to_pylist()
            for lo, hi, part in K.text_chunks(texts, CHUNK):
                e = enc.encode(part)
                null = pa.array([t is None for t in texts[lo:hi]], pa.bool_())
                offsets = pa.array(e.first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v), mask=null) for v in (e.ids, e.starts, e.ends)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *lists, pa.array(e.roundtrip, mask=null.to_numpy(zero_copy_only=False))], ["doc_id", "ids", "starts", "ends", "roundtrip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, roundtrip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of each row of encoded (doc_id, ids): the normalised text; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            text = [None if i is None else enc.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
