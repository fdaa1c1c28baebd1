"""Token ids as bytes: each document compressed by itself with one shared Zstandard dictionary.

The ids of a document are serialised as little-endian 16-bit numbers (32-bit
where the vocabulary needs it).  The dictionary is trained on all documents:
each task trains a small dictionary on every SAMPLES bytes of serialised ids
it reads, these are the samples of the next training, and so on until few
enough are left for the last one.  Where there is too little text to train on,
the samples themselves are the dictionary, and without any text there is none.

The dictionary is stored with the documents, as a row of shard -1: what
``pack`` gives can be decoded by itself (``decode``).  Each row carries its
shard (the partition that wrote it), its offset and length in the shard's file
that ``write_store`` makes, and the dictionary's hash, so that one short
document is read by one seek and decompressed with a dictionary that is known
to fit.

Defined results
    null text: no tokens stored (n_tokens null, empty blob).  Empty text: 0 tokens, a blob of an empty array.
    very long texts: stored whole.  Empty table: the row of an empty dictionary.
    repeated rows: each is stored.  Null doc_id: stored as null.  Extra columns: ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

VOCABULARY = os.path.join(os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
DICT_BYTES = 112_640
SAMPLES = 4 << 20  # bytes of ids that one small dictionary is trained on
SMALL_BYTES = 8192
PIECE = 256  # bytes of a small dictionary that are one sample
SEGMENTS = {"k": 256, "d": 8}  # of small dictionaries, fixed instead of searched for
MERGED = 400  # small dictionaries that are merged at a time
LEVEL = 3
SCHEMA = "doc_id long, n_tokens int, shard int, offset long, length int, dict_hash string, blob binary"


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def width(path: str) -> type:
    return np.dtype("<u2") if tokenizer(path).max_token_value < 1 << 16 else np.dtype("<u4")


def serialise(text: str, path: str) -> bytes:
    return np.asarray(tokenizer(path).encode_ordinary(text), width(path)).tobytes()


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES, **kw) -> bytes:
    """A trained dictionary, or raw content where that fails, or nothing."""
    import zstandard

    samples = [bytes(s) for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, **kw).as_bytes() if len(samples) >= 8 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _codec(dictionary: bytes, level: int = LEVEL):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    kw = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=level, write_dict_id=False, **kw), zstandard.ZstdDecompressor(**kw)


def dict_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, raw: the serialised ids of each document, cut from its lineage; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if t is None else serialise(t, path) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return K.saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, raw binary"))


def fit(rows: DataFrame, size: int = DICT_BYTES) -> bytes:
    """The dictionary of rows (raw), trained on all of them."""

    def small(batches: Iterator[pa.RecordBatch], piece: int = SMALL_BYTES) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n = 0
        for batch in batches:
            for x in batch.column("raw").to_pylist():
                # a long document is samples of its parts
                held += [x[a : a + piece] for a in range(0, len(x or b""), piece)]
                n += len(x or b"")
                if n >= SAMPLES:
                    yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(held, SMALL_BYTES, **SEGMENTS)], pa.binary())], ["raw"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(held, SMALL_BYTES, **SEGMENTS)], pa.binary())], ["raw"])

    made = K.saved(rows.select("raw").mapInArrow(small, "raw binary"))
    while (n := made.count()) > MERGED:
        made = K.saved(made.repartition(-(-n // MERGED)).mapInArrow(lambda b: small(b, PIECE), "raw binary"))
    # at most MERGED small dictionaries, each cut into samples
    parts = sorted(r[0] for r in made.collect())
    return train_dictionary([p[a : a + PIECE] for p in parts for a in range(0, len(p), PIECE)], size)


def pack(docs: DataFrame, path: str = VOCABULARY, dictionary: bytes | None = None, level: int = LEVEL) -> DataFrame:
    """doc_id, n_tokens, shard, offset, length, dict_hash, blob for each row of docs (doc_id, text), and the dictionary in a row of shard -1."""
    rows = tokens(docs, path)
    d = fit(rows) if dictionary is None else dictionary
    spark = docs.sparkSession
    shared, name, item = spark.sparkContext.broadcast(d), dict_hash(d), width(path).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, _ = _codec(shared.value, level)
        context = TaskContext.get()
        shard, offset = context.partitionId() if context else 0, 0
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            blobs = [b"" if r is None else comp.compress(r) for r in raws]
            counts = [None if r is None else len(r) // item for r in raws]
            length = np.fromiter(map(len, blobs), np.int64, len(blobs))
            offsets = offset + np.cumsum(length) - length
            offset += int(length.sum())
            n = len(raws)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(offsets), pa.array(length.astype(np.int32)), pa.array([name] * n, pa.string()), pa.array(blobs, pa.binary())],
                ["doc_id", "n_tokens", "shard", "offset", "length", "dict_hash", "blob"],
            )

    first = spark.createDataFrame([(None, None, -1, 0, len(d), name, d)], SCHEMA)
    return rows.mapInArrow(run, SCHEMA).unionByName(first)


def dictionary_of(packed: DataFrame) -> bytes:
    """The dictionary that what pack gave holds."""
    return bytes(packed.filter("shard = -1").select("blob").first()[0])


def decode(packed: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, text of each document that pack gave."""
    shared = packed.sparkSession.sparkContext.broadcast(dictionary_of(packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, codec = _codec(shared.value)
        known = dict_hash(shared.value)
        for batch in batches:
            texts = []
            for n, blob, name in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "blob", "dict_hash"))):
                if name != known:
                    raise ValueError("the blob was compressed with another dictionary")
                texts.append(None if n is None else tokenizer(path).decode(np.frombuffer(codec.decompress(blob), width(path)).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "text"])

    return packed.filter("shard >= 0").select("doc_id", "n_tokens", "blob", "dict_hash").mapInArrow(run, "doc_id long, n_tokens int, text string")


def unpack(blob: bytes, dictionary: bytes, path: str = VOCABULARY, expected: str | None = None) -> list[int]:
    """The ids in a blob; refuses a dictionary whose hash isn't the expected one."""
    if expected is not None and dict_hash(dictionary) != expected:
        raise ValueError("the blob was compressed with another dictionary")
    return np.frombuffer(_codec(dictionary)[1].decompress(blob), width(path)).tolist() if blob else []


def write_store(docs: DataFrame, folder: str, path: str = VOCABULARY) -> None:
    """Writes folder/dictionary.zdict, folder/shard-N.bin and the offset index folder/index.parquet (a folder all executors share, local or of a file system that pyarrow knows by its URI).

    A shard is written under the attempt's own name and then renamed, so that lost and repeated tasks leave one whole file."""
    packed = pack(docs, path)
    d = dictionary_of(packed)
    fs, base = pa_fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    fs.create_dir(base)
    with fs.open_output_stream(f"{base}/dictionary.zdict") as f:
        f.write(d)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{base}/.shard-{context.partitionId()}-{context.taskAttemptId()}"
        fs_, _ = pa_fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        shard = None
        with fs_.open_output_stream(attempt) as f:
            for batch in batches:
                shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
                for blob in batch.column("blob").to_pylist():
                    f.write(blob)
                yield batch.select(["doc_id", "n_tokens", "shard", "offset", "length", "dict_hash"])
        fs_.delete_file(attempt) if shard is None else fs_.move(attempt, f"{base}/shard-{shard}.bin")

    packed.filter("shard >= 0").mapInArrow(store, "doc_id long, n_tokens int, shard int, offset long, length int, dict_hash string").write.mode("overwrite").parquet(f"{folder}/index.parquet")


def read_document(folder: str, row: dict, path: str = VOCABULARY) -> list[int]:
    """The ids of the document of one index row: one seek in its shard."""
    fs, base = pa_fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    with fs.open_input_file(f"{base}/dictionary.zdict") as f:
        d = f.read()
    with fs.open_input_file(f"{base}/shard-{row['shard']}.bin") as f:
        f.seek(row["offset"])
        return unpack(f.read(row["length"]), d, path, row["dict_hash"])
