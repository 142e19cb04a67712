"""Near copies by the ball join of operator 4, with fingerprints that follow Jaccard similarity, each pair being verified.

At a Jaccard similarity of 0.8 fingerprints of operator 4's own kind differ in ten bits of 64, far beyond its radius. Here a text has
PRINTS fingerprints of BITS bits, four bits from each of ten minimum hashes of its five-word shingles, so that those of
texts at 0.8 differ in few. As there, every fingerprint emits all values within half the radius, values are shuffled, and texts
whose fingerprints are within the radius meet: of pairs at 0.8 some 97 of 100 do in one fingerprint or another, of those
at 0.9 all. At every value the others are held against the first in one of ORDERS orders, so no pairs of a group are
formed; each candidate is verified on the shingles themselves, and components of what is left are the groups.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, row_key, staged
from .components import components
from .simhash import dealt, met

SHINGLE, LIKE = 5, 0.8
#: Fingerprints of a text, their bits, and the minimum hashes in each.
PRINTS, BITS, MINIMA = 9, 40, 10
ORDERS = 6
#: All values within one bit; two fingerprints within two bits have one in common.
BALL = np.array([0, *(1 << i for i in range(BITS))], np.uint64)
_TURN = mix(np.arange(1, PRINTS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of `size` words (of all words of a shorter text; of nothing for an empty one), and how many each text has."""
    n = np.diff(words.of)
    count = np.maximum(n - size + 1, 1)
    first = np.repeat(words.of[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    long = np.repeat(n, count)
    out = np.full(len(first), size, np.uint64)
    word = words.hash if len(words.hash) else np.zeros(1, np.uint64)
    for j in range(size):
        out = np.where(j < long, mix(out * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(first + j, len(word) - 1)]), out)
    return out, count


def _prints(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints for each run of hashes, the number of the fingerprint being above its bits."""
    begin, each = np.cumsum(count) - count, BITS // MINIMA
    out = np.empty((len(count), PRINTS), np.uint64)
    for k in range(PRINTS):
        value = np.full(len(count), k, np.uint64)
        for turn in _TURN[k * MINIMA : (k + 1) * MINIMA]:
            least = np.minimum.reduceat((hashes ^ turn) * (turn | np.uint64(1)), begin)
            value = value << np.uint64(each) | mix(least + turn) >> np.uint64(64 - each)
        out[:, k] = value
    return out


def _printed(batches):
    for batch in batches:
        for piece in pieces(batch):
            prints = _prints(*_shingles(Words(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array([x.tobytes() for x in prints], pa.binary())], ["node", "prints"])


def _values(column: pa.Array) -> np.ndarray:
    """The values of the balls of all fingerprints of each text."""
    prints = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PRINTS, 1)
    return mix(prints ^ BALL)


def _candidates(table: pa.Table) -> pa.Table:
    pairs = met(table, ORDERS)
    return pa.table({"a": pa.array(pairs.min(axis=0).view(np.int64)), "b": pa.array(pairs.max(axis=0).view(np.int64))})


def _sets(batches):
    """The distinct shingles of each text, sorted, as bytes."""
    for batch in batches:
        for piece in pieces(batch):
            hashes, count = _shingles(Words(piece.column("text")))
            ends = np.cumsum(count)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends - count, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def _alike(batches):
    for batch in batches:
        of = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("x", "y")]
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*of, strict=True)], np.int64)
        size = np.array([len(x) + len(y) for x, y in zip(*of, strict=True)], np.int64)
        yield batch.filter(pa.array(both >= LIKE * (size - both))).select(["a", "b"])


def _node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): verified links between texts, each named by its 64-bit hash."""
    once = docs.select(_node(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    prints = staged(once.mapInArrow(_printed, "node long, prints binary").dropDuplicates(["node"]), "prints")
    pairs = staged(dealt(prints, prints.count(), _values, PRINTS * len(BALL), "node", "prints", ORDERS).applyInArrow(_candidates, "a long, b long").distinct(), "candidates")
    some = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    single = once.groupBy("node").agg(F.first("text").alias("text"))  # copies go within tasks, before the shuffle; a semi join would be moved below this
    sets = staged(single.join(some, "node").mapInArrow(_sets, "node long, shingles binary"), "shingles")
    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    sized = pairs.join(x, "a").join(y, "b").where(F.least(F.length("x"), F.length("y")) >= LIKE * F.greatest(F.length("x"), F.length("y")))
    return sized.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay: exactly one of each group of texts that verified links join; that of the smallest id (nulls last), then by hash.

    Groups are those of texts, so rows that share an id with another text, or have none, are judged as any other. Texts
    without words are alike. An empty table gives an empty one. Columns may have any names: a row is carried as one value.
    """
    part = staged(components(links(docs, text)), "components")
    rows = docs.select(_node(text).alias("node"), F.col(id_col).alias("id"), row_key(docs).alias("row"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node", "row")
    named = rows.join(part, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(order)["row"].alias("row"))
    return docs.select(F.struct(*docs.columns).alias("doc"), row_key(docs).alias("row")).join(named.select("row"), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
