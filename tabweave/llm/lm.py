"""Operator 1: language-model scoring with an interpolated modified Kneser-Ney bigram model.

Counting is two shuffles of pre-aggregated, packed counts. Map tasks reduce their part of the corpus to distinct
(context, word) pairs of 64-bit hashes; a shard of contexts merges them, writes its pairs and context totals as
sorted arrays into the shared folder, and passes on how many contexts each word follows; a shard of words merges
those into the unigram arrays. Scoring tasks memory-map the arrays and look their own distinct pairs up in sorted order.
Nothing but a row of sums for each shard reaches the driver.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fold, mapped, mix, new_path, pieces, put_file

BOS, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Pairs held by a map task before it packs and passes them on.
HOLD = 4_000_000
#: Text for each shard.
SHARD_BYTES = 8 << 20
STATS = [*(f"pair_n{i}" for i in range(1, 5)), *(f"word_n{i}" for i in range(1, 5)), "pairs", "words", "tokens"]


def _key(u: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Of a pair; its leading bits are the context's, so that a shard is a range of keys."""
    low = mix(mix(u) + w) & np.uint64((1 << 64 - bits) - 1)
    return u >> np.uint64(64 - bits) << np.uint64(64 - bits) | low


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token, each text's words being followed by its end; where each text's tokens begin."""
    words = Words(texts)
    n = len(texts)
    w = np.empty(len(words.hash) + n, np.uint64)
    w[np.arange(len(words.hash)) + np.repeat(np.arange(n), np.diff(words.of))] = words.hash
    first = words.of[:-1] + np.arange(n)
    w[words.of[1:] + np.arange(n)] = END
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[first] = BOS
    return u, w, first


def _distinct(key, *summed):
    """Sorted distinct keys, with the sums of the rest, and an index of one occurrence of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], [np.add.reduceat(x[order], first) if len(key) else x for x in summed], order[first]


def _pack(*arrays) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _by_shard(sorted_keys: np.ndarray, bits: int):
    """(shard, from, to) of each shard that has keys."""
    shard = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
        if b > a:
            yield int(shard[a]), int(a), int(b)


def _count_map(bits: int):
    def emit(u, w):
        key, (c,), at = _distinct(_key(u, w, bits), np.ones(len(u), np.int64))
        u, w = u[at], w[at]
        order = np.argsort(u, kind="stable")
        u, w, c = u[order], w[order], c[order]
        out = {"shard": [], "payload": []}
        for shard, a, b in _by_shard(u, bits):
            starts = np.flatnonzero(np.append(True, u[a + 1 : b] != u[a : b - 1]))
            out["shard"].append(shard)
            out["payload"].append(_pack(u[a:b][starts], np.diff(np.append(starts, b - a)).astype(np.uint32), w[a:b], c[a:b].astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["payload"], pa.binary())], ["shard", "payload"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch):
                u, w, _ = _pairs(piece.column("text"))
                held.append((u, w))
                n += len(u)
                if n >= HOLD:
                    yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _merge_pairs(bits: int, path: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        us, ws, cs = [], [], []
        for blob in table.column("payload").to_pylist():
            u, runs, w, c = _unpack(blob, np.uint64, np.uint32, np.uint64, np.uint32)
            us.append(np.repeat(u, runs))
            ws.append(w)
            cs.append(c)
        u, w, c = np.concatenate(us), np.concatenate(ws), np.concatenate(cs).astype(np.int64)
        key, (c,), at = _distinct(_key(u, w, bits), c)
        u, w = u[at], w[at]
        single = c == 1
        put_file(f"{path}/single/{shard}", [key[single]])
        put_file(f"{path}/multi/{shard}", [key[~single], c[~single].astype(np.uint64)])
        ctx, (total, n1, n2, n3), _ = _distinct(u, c, *((c == i).astype(np.int64) for i in (1, 2)), (c >= 3).astype(np.int64))
        put_file(f"{path}/context/{shard}", [x.astype(np.uint64) for x in (ctx, total, n1, n2, n3)])
        word, (follows, raw), _ = _distinct(w, np.ones(len(w), np.int64), c)
        rows = [(s, _pack(word[a:b], follows[a:b].astype(np.uint32), raw[a:b].astype(np.uint64))) for s, a, b in _by_shard(word, bits)]
        stats = {f"pair_n{i}": int((c == i).sum()) for i in range(1, 5)} | {"pairs": len(c), "tokens": int(c.sum())}
        return pa.table(
            {"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())}
            | {k: pa.array([v] + [0] * (len(rows) - 1), pa.int64()) for k, v in stats.items()}
        )

    return run


def _merge_words(path: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_unpack(b, np.uint64, np.uint32, np.uint64) for b in table.column("payload").to_pylist()]
        word, follows, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        word, (follows, raw), _ = _distinct(word, follows.astype(np.int64), raw.astype(np.int64))
        put_file(f"{path}/word/{shard}", [x.astype(np.uint64) for x in (word, follows, raw)])
        sums = {k: pa.compute.sum(table.column(k)).as_py() for k in STATS if k.startswith("pair") or k == "tokens"}
        sums |= {f"word_n{i}": int((follows == i).sum()) for i in range(1, 5)} | {"words": len(word)}
        return pa.table({"shard": pa.array([shard], pa.int32())} | {k: pa.array([sums[k]], pa.int64()) for k in STATS})

    return run


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from counts of counts; where the estimate is undefined or out of range, 0.5, 1 and 1.5 stand in."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
        if all(0 < x <= i for i, x in enumerate(d, 1)):
            return d
    return [0.5, 1.0, 1.5]


def train(docs: DataFrame, text: str = "text") -> dict:
    """Counts every text and stores the model in the shared folder; returns where it is, and its sums.

    Null texts count as empty. An empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    path = new_path(spark, "lm")
    counted = docs.mapInArrow(_count_map(bits), "shard int, payload binary")
    some = ", ".join(f"{k} long" for k in STATS if k.startswith("pair") or k == "tokens")
    pairs = counted.groupBy("shard").applyInArrow(_merge_pairs(bits, path), f"shard int, payload binary, {some}")
    words = pairs.groupBy("shard").applyInArrow(_merge_words(path), "shard int, " + ", ".join(f"{k} long" for k in STATS))
    sums = {k: int(v or 0) for k, v in words.agg(*(F.sum(k).alias(k) for k in STATS)).first().asDict().items()}
    return {"path": path, "bits": bits, "pair_d": _discounts([sums[f"pair_n{i}"] for i in range(1, 5)]), "word_d": _discounts([sums[f"word_n{i}"] for i in range(1, 5)])} | sums


class Model:
    """The sorted arrays, memory-mapped; a shard is opened when first needed."""

    def __init__(self, about: dict):
        self.about = about

    def find(self, kind: str, keys: np.ndarray, columns: int) -> np.ndarray:
        """The columns after the key for each of the sorted keys; zeros where it isn't there."""
        out = np.zeros((max(1, columns - 1), len(keys)))
        for shard, a, b in _by_shard(keys, self.about["bits"]):
            table = mapped(f"{self.about['path']}/{kind}/{shard}").reshape(columns, -1)
            if not table.shape[1]:
                continue
            at = np.minimum(np.searchsorted(table[0], keys[a:b]), table.shape[1] - 1)
            hit = table[0][at] == keys[a:b]
            for j in range(max(1, columns - 1)):
                out[j, a:b][hit] = table[j + 1][at[hit]] if columns > 1 else 1
        return out

    def score(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each token, that of the smoothed unigram base, and the token's training count."""
        m = self.about
        words, back = np.unique(w, return_inverse=True)
        follows, raw = self.find("word", words, 3)
        d = np.array([0.0, *m["word_d"]])
        spread = sum(x * n for x, n in zip(m["word_d"], [m["word_n1"], m["word_n2"], m["words"] - m["word_n1"] - m["word_n2"]], strict=True))
        uni = (follows - d[np.minimum(follows, 3).astype(int)] + spread / (m["words"] + 1)) / m["pairs"] if m["pairs"] else np.ones(len(words))
        base = np.log10((raw + 0.5) / (m["tokens"] + 0.5 * (m["words"] + 1)))
        contexts, from_u = np.unique(u, return_inverse=True)
        total, n1, n2, n3 = self.find("context", contexts, 5)
        d1, d2, d3 = m["pair_d"]
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / total, 1.0)
        keys, from_key = np.unique(_key(u, w, m["bits"]), return_inverse=True)
        c = (self.find("single", keys, 1)[0] + self.find("multi", keys, 2)[0])[from_key]
        d = np.array([0.0, d1, d2, d3])
        p = (c - d[np.minimum(c, 3).astype(int)]) / np.maximum(total[from_u], 1) + weight[from_u] * uni[back]
        return np.log10(p), base[back], raw[back]


def score(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_tokens, n_known, base_score, score and perplexity; a null text is scored as empty (its end alone).

    Rows that repeat are scored each; an empty table gives no row; other columns are not looked at. A text is handled alone from
    2 MB on, in some 60 bytes of memory for each of its bytes.
    """

    def run(batches):
        m = Model(model)
        for batch in batches:
            for piece in pieces(batch):
                u, w, first = _pairs(piece.column("text"))
                p, base, raw = m.score(u, w)
                n = np.diff(np.append(first, len(w)))
                s = np.add.reduceat(p, first)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n), pa.array(np.add.reduceat((raw > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(s), pa.array(10 ** (-s / n))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those whose fold isn't 1 (a null id counts as not 1)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    model = train(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
