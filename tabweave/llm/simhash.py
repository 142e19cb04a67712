"""Operator 4: SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most four bits have a value within two bits of both. Every distinct
fingerprint therefore emits the 2081 values of its ball of radius two; the values are shuffled, and those who meet at
one are within four bits of each other, so linking each to the smallest there loses no link. A ball is only emitted by
a fingerprint that agrees with some other on at least four of its eight bytes: any pair within four bits does, so this
leaves out fingerprints that can have no partner, and no pair.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, staged
from .components import components

SHINGLE = 4
RADIUS = 4
BALL = np.array([0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))], np.uint64)
#: Keys in a bucket, about.
BUCKET = 1_500_000


def _shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of each text, and how many it has."""
    lens = words.end - words.start
    joined = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    solid = np.flatnonzero(words.solid[1:-1])
    joined[np.arange(len(solid)) + np.repeat(np.arange(len(lens)), lens)] = words.data[solid]
    begin = np.cumsum(lens + 1) - lens - 1
    end = begin + lens
    n = np.diff(words.of)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.repeat(words.of[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = first + np.repeat(np.minimum(n, size) - 1, count)
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(begin[first].tolist(), end[last].tolist(), strict=True)
    return np.fromiter((digest(data[a:b], 42) for a, b in spans), np.uint64, int(count.sum())), count


def _fold_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes."""
    out, ends = np.zeros(len(count), np.uint64), np.cumsum(count)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(ends - count, ends, strict=True)):
        total = np.zeros(64, np.int64)
        for at in range(a, b, 1 << 16):
            total += np.unpackbits(hashes[at : min(b, at + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weights[2 * total > b - a].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row. A null text, or one without words, has fingerprint zero.

    Other columns are not looked at; an empty table gives no row. A text is handled alone from 2 MB on, so a worker holds one long one at a time.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                fp = _fold_bits(*_shingle_hashes(Words(piece.column("text")), size))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


#: Masks over four of eight bytes.
AGREE = np.array([sum(0xFF << 8 * i for i in four) for four in combinations(range(8), 4)], np.uint64)


def _agreements(fp: np.ndarray) -> np.ndarray:
    """A key for each choice of four bytes."""
    return mix(mix(fp[:, None] & AGREE) + np.arange(len(AGREE), dtype=np.uint64))


def _ball(fp: np.ndarray) -> np.ndarray:
    """The values of each ball, mixed so that a family of near copies, whose leading bits agree, is spread over the buckets."""
    return mix(fp[:, None] ^ BALL)


def _heads(key: np.ndarray, of: np.ndarray, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the first item at each, and the pairs (item, first) of the others.

    First is the smallest; with several orders, each key takes one of them, a mixing of the items of its own.
    """
    rank = of if orders == 1 else mix(of + key.astype(np.uint64) % np.uint64(orders))
    order = np.lexsort((rank, key))
    key, of = key[order], of[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    head = np.repeat(of[first], np.diff(np.append(first, len(key))))
    pairs = np.stack([of, head])[:, of != head]
    return key[first], of[first], np.unique(pairs, axis=1) if pairs.size else pairs


def spread(keys, each: int, bits: int, item: str, value: str, orders: int):
    """Every item with each of its keys (keys(values): an array of `each` for each item), packed by the leading bits of the key.

    Items that share a key within a batch are paired there, and the first of them alone goes on with the key; so a
    key that many items have takes no more room in its bucket than there are batches.
    """

    def run(batches):
        for batch in batches:
            step = max(1, (3 << 19) // each)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                key = keys(part.column(value)).ravel()
                of = np.repeat(part.column(item).to_numpy().view(np.uint64), each)
                order = np.argsort(key)
                key, of = key[order], of[order]
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                key = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)  # the rest is told apart by what verifies the pairs
                out = {"bucket": [], "payload": []}
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                    if b > a:
                        once, first, pairs = _heads(key[a:b], of[a:b], orders)
                        out["bucket"].append(int(bucket[a]))
                        out["payload"].append(b"".join([np.array([len(once)], np.uint64).tobytes(), first.tobytes(), once.tobytes(), pairs.tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["payload"], pa.binary())], ["bucket", "payload"])

    return run


def met(table: pa.Table, orders: int) -> np.ndarray:
    """The pairs (2, n) of a bucket: those found before, and those of items that meet in it."""
    keys, items, pairs = [], [], []
    for raw in table.column("payload").to_pylist():
        n = int(np.frombuffer(raw, np.uint64, 1)[0])
        items.append(np.frombuffer(raw, np.uint64, n, 8))
        keys.append(np.frombuffer(raw, np.uint32, n, 8 + 8 * n))
        pairs.append(np.frombuffer(raw, np.uint64, -1, 8 + 12 * n).reshape(2, -1))
    return np.unique(np.concatenate([*pairs, _heads(np.concatenate(keys), np.concatenate(items), orders)[2]], axis=1), axis=1)


def dealt(items: DataFrame, n: int, keys, each: int, item: str, value: str, orders: int = 1):
    """The n items spread by key, and grouped into buckets of about BUCKET keys."""
    bits = max(4, (n * each // BUCKET).bit_length())
    return items.repartition(n * each // BUCKET + 2).mapInArrow(spread(keys, each, bits, item, value, orders), "bucket int, payload binary").groupBy("bucket")


def _of_prints(keys):
    return lambda column: keys(column.to_numpy().view(np.uint64))


def _partnered(table: pa.Table) -> pa.Table:
    return pa.table({"fp": pa.array(np.unique(met(table, 1)).view(np.int64))})


def _meet(radius: int):
    def run(table: pa.Table) -> pa.Table:
        pair = met(table, 1)
        pair = pair[:, np.bitwise_count(pair[0] ^ pair[1]) <= radius]
        root: dict[int, int] = {}

        def top(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        kept = []
        for a, b in pair.T.tolist():  # a spanning forest of this bucket's links says as much as all of them
            if (x := top(a)) != (y := top(b)):
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
        kept = np.array(kept, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(kept[:, 0]), "b": pa.array(kept[:, 1])})

    return run


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (fp) which differ in at most four bits, directly or by way of others."""
    fps = staged(fps.distinct(), "distinct")
    some = staged(dealt(fps, fps.count(), _of_prints(_agreements), len(AGREE), "fp", "fp").applyInArrow(_partnered, "fp long").distinct(), "partnered")
    return dealt(some, some.count(), _of_prints(_ball), len(BALL), "fp", "fp").applyInArrow(_meet(RADIUS), "a long, b long").distinct()


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id that links reach, itself included.

    Repeated rows and ids each keep their row. A null id takes part, but names a component only if all its ids are null.
    """
    prints = staged(fingerprints(docs, text, id_col, size), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    part = staged(components(links(least.select("fp"))), "components").withColumnRenamed("node", "fp")
    named = least.join(part, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    of = least.join(part.join(named, "component").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of, "fp")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
