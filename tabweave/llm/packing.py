"""Operator 6: packing documents into training sequences along a Hilbert curve.

A document's token counts, hashed to buckets and normalised, are projected to three dimensions; its place on the
Hilbert curve through them is its sort key. Ids are staged once, compressed. Only (key, id, length) is range-sorted, by
key and then id so that copies of one text spread over partitions; sums of partitions give every document its place in
one unbroken stream of tokens, which is cut every `length` tokens, so that only the last sequence can be short.
"""

import base64
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, pieces, staged

LENGTH = 1024
BUCKETS, DIMENSIONS, BITS = 1024, 3, 10
#: Runs of white space from this length on are encoded apart, as the pattern's search gives up on very long ones.
RUN = 1 << 16
#: What Unicode calls white space, as the pattern does.
_RUNS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % RUN)
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, special: dict[str, int], pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The byte-level BPE of a ranks file, kept for the life of the worker; strings in special are one token each wherever they stand."""
    key = f"{path} {sorted(special.items())} {pattern}"
    if key not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[key]


def token_ids(text: str, path: str, special: dict[str, int]) -> np.ndarray:
    """The ids of a text of any length.

    Of a run of white space the pattern leaves the last character to the word that follows, so a long run without it is one
    piece; before a special string, or at the end, the whole run is.
    """
    enc, out, at = encoding(path, special), [], 0
    for run in _RUNS.finditer(text):
        end = run.end() if run.end() == len(text) or text.startswith(tuple(special), run.end()) else run.end() - 1
        out += [enc.encode_to_numpy(text[at : run.start()], allowed_special="all"), encoding(path, {}, "(?s).+").encode_to_numpy(text[run.start() : end])]
        at = end
    rest = enc.encode_to_numpy(text[at:] if at else text, allowed_special="all")
    return np.concatenate([*out, rest]) if out else rest


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer file takes for one token before it splits a text."""
    with open(path) as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each column of x (dimensions, n): integers of so many bits.

    The axes are turned to the transposed index by undoing, from the highest bit, the exchanges and inversions of each level.
    """
    x = x.astype(np.int64).copy()
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << bits - 1
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _place(ids: list[np.ndarray]) -> np.ndarray:
    bucket = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    axes = np.random.default_rng(6).normal(size=(BUCKETS, DIMENSIONS))
    counts = np.sqrt(np.stack([np.bincount(bucket[x & 0xFFFF], minlength=BUCKETS) for x in ids]))
    v = counts @ axes / np.maximum(np.linalg.norm(counts, axis=1), 1e-9)[:, None]
    return hilbert(np.minimum(((np.tanh(v) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1).T)


def _tokenise(path: str, special: dict[str, int]):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece in pieces(batch):
                ids = [np.append(token_ids(t, path, special), 0).astype("<u4") for t in piece.column("text").to_pylist()]
                small = [x.astype("<u2") if x.max() < 1 << 16 else x for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(_place(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.itemsize for x in small], pa.int32()), pa.array([pack(x.tobytes()) for x in small], pa.binary())],
                    ["doc_id", "place", "doc_tokens", "width", "ids"],
                )

    return run


def _cut(length: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            row, out = [], [[] for _ in names[1:]]
            for i, (at, n, width, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "doc_tokens", "width", "ids")), strict=True)):
                data = np.frombuffer(unpack(blob), f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    size = min(n - start, length - (at + start) % length)
                    row.append(i)
                    for column, value in zip(out, (start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, (at + start) // length, (at + start) % length), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names)

    return run


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, tokenizer: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a ranks file; special: strings that are one token each, by default those that the same vocabulary's
    tokenizer file adds. A null text is an empty one: its single token is the end, 0. Rows that repeat an id
    are packed each for itself; a null id stays null. An empty table gives no piece; other columns are not looked at. A
    text's ids are held at once in a task.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    special = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if special is None else special
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tokens = staged(rows.mapInArrow(_tokenise(tokenizer, special), f"doc_id {kind}, place long, doc_tokens long, width int, ids binary").withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = ["place", "doc_id", "row"]
    ranged = staged(tokens.select(*order, "doc_tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.sum("doc_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0))).join(bases, "part").select("row", (F.col("base") + F.col("inside")).alias("at"))
    return tokens.join(placed, "row").select("doc_id", "at", "doc_tokens", "width", "ids").mapInArrow(_cut(length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
