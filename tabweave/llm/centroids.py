"""Operator 11: k-means by exponion search, exact in integers.

Every vector carries its cluster, an upper bound on the distance to that centroid and a lower bound on the distance to any
other. When centroids have moved, the bounds move with them; where the upper bound stays below the lower one (or below half
the way to the next centroid), nothing is computed. Else only centroids inside a ball around the current one are scanned: its radius
is twice the distance to the vector and once the way to the next centroid, which holds the two nearest. Each centroid
has the others sorted by distance, so that the ball is a beginning of that list; the radius is inclusive, so ties are kept. Bounds are rounded
outwards, and distances compared are whole numbers, so no rounding decides.

Vectors are packed in blocks and written once, bucketed by block in the shared folder. A round streams them beside last
round's bounds, joined by block: bounds alone are shuffled. A task adds up its vectors by cluster, Spark adds
those sums up, and the driver gets one row of sums for each cluster and component.
"""

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

CLUSTERS, ROUNDS, SCALE, DIMENSIONS = 8, 10, 1024, 64
#: Vectors of a block.
BLOCK = 4096
#: Bytes of vectors in a bucket, about.
BUCKET_BYTES = 128 << 20
#: Components (before scaling) from which a vector isn't kept, so that sums of them fit a decimal of 38 digits.
LARGEST = 1e24
#: Whole numbers up to which squared distances of so many components fit 64 bits; beyond, Python's integers are used.
_SMALL, _FEW = 1 << 26, 128
_FIT = (1 << 63) - 1


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers where all are small, else as Python's."""
    scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() <= _SMALL and x.shape[1] <= _FEW:
        return scaled.astype(np.int64)
    return np.array([[math.floor(v * scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _up(squares: np.ndarray) -> np.ndarray:
    """Square roots, never too small."""
    return np.sqrt(squares.astype(float)) * (1 + 1e-12)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 - 1e-12)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


class Centroids:
    """Centroids with the sorted lists of the others, and how far each has moved (rounded up)."""

    def __init__(self, places: list[list[int]], before: list[list[int]] | None = None):
        small = max((abs(v) for p in places for v in p), default=0) <= _SMALL and all(len(p) <= _FEW for p in places)
        self.at = np.array(places, dtype=np.int64 if small else object)
        apart = np.stack([_squares(self.at, p) for p in self.at])
        self.order = np.argsort(apart, axis=1, kind="stable")  # each stands first in its own list, or beside its equals
        self.apart = np.take_along_axis(_down(apart), self.order, axis=1)
        others = apart + np.zeros_like(apart)
        np.fill_diagonal(others, 2 * int(apart.max()) + 1)
        self.next_low, self.next_high = _down(others.min(axis=1)), _up(others.min(axis=1))
        self.moved = _up(_squares(self.at, np.array(before, dtype=self.at.dtype))) if before else np.zeros(len(places))

    def assign(self, x: np.ndarray, of: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(cluster, upper, lower) of every vector; of, upper, lower: those from before the centroids moved."""
        n, k = len(x), len(self.at)
        if of is None:
            of, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
        else:
            far = np.argsort(self.moved)[::-1]
            most, second = self.moved[far[0]], self.moved[far[1]] if k > 1 else 0.0
            of, upper = of.copy(), (upper + self.moved[of]) * (1 + 1e-12)
            lower = (lower - np.where(of == far[0], second, most)) * (1 - 1e-12)
        bound = np.maximum(lower, self.next_low[of] / 2)
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = _up(_squares(x[open_], self.at[of[open_]]))
        open_ = open_[~(upper[open_] < bound[open_])]
        if k == 1:
            lower[open_] = np.inf
            return of, upper, lower
        radius = (2 * upper[open_] + self.next_high[of[open_]]) * (1 + 1e-12)
        inside = (self.apart[of[open_]] <= radius[:, None]).sum(axis=1)  # the lists are sorted
        big = object in (self.at.dtype, x.dtype)
        best = np.full(len(open_), math.inf if big else _FIT, object if big else np.int64)
        other, name = best.copy(), np.full(len(open_), k)
        for rank in range(int(inside.max(initial=0))):
            rows = np.flatnonzero(inside > rank)
            j = self.order[of[open_[rows]], rank]
            d = _squares(x[open_[rows]], self.at[j])
            nearer = (d < best[rows]) | (d == best[rows]) & (j < name[rows])
            other[rows] = np.where(nearer, best[rows], np.minimum(other[rows], d))
            best[rows], name[rows] = np.where(nearer, d, best[rows]), np.where(nearer, j, name[rows])
        of[open_], upper[open_], lower[open_] = name, _up(best), _down(other)
        return of, upper, lower


def _pack(dims: int, wide: bool):
    """Blocks of at most BLOCK vectors: their ids, and their components as bytes."""

    def run(batches):
        part, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids, vectors = some.column("vec_id"), some.column("vector").flatten().to_numpy()
                data = vectors.astype("<f8" if wide else "<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part + n]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())], ["block", "ids", "data"])
                n += 1

    return run


def _blocks(batch: pa.RecordBatch, dims: int, wide: bool, scale: int):
    """(row, whole components, state or None) of each block of a batch."""
    state = batch.column("state").to_pylist() if "state" in batch.schema.names else [None] * batch.num_rows
    for i, (data, known) in enumerate(zip(batch.column("data").to_pylist(), state, strict=True)):
        x = _whole(np.frombuffer(data, "<f8" if wide else "<f4").astype(float).reshape(-1, dims), scale)
        yield i, x, known


def _pair(state: bytes | None, n: int) -> tuple:
    """Clusters and bounds of a block, as they were packed."""
    if state is None:
        return None, None, None
    both = np.frombuffer(state[4 * n :], float).reshape(2, n).copy()
    return np.frombuffer(state[: 4 * n], np.int32), *both


def _round(now: Centroids, dims: int, wide: bool, scale: int):
    """A row (block, state) for each block, and in the end a row (cluster, n, sums) for each cluster that has vectors."""

    def run(batches):
        n, sums = np.zeros(len(now.at), np.int64), [[0] * dims for _ in now.at]
        for batch in batches:
            rows, states = [], []
            for i, x, known in _blocks(batch, dims, wide, scale):
                of, upper, lower = now.assign(x, *_pair(known, len(x)))
                rows.append(i)
                states.append(of.astype(np.int32).tobytes() + np.stack([upper, lower]).tobytes())
                for j in np.unique(of):
                    own = x[of == j]
                    n[j] += len(own)
                    sums[j] = [a + int(b) for a, b in zip(sums[j], own.sum(axis=0), strict=True)]
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(rows, pa.int64())), pa.array(states, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.string()))], _STATE)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(n[some]), pa.array([[str(v) for v in sums[j]] for j in some], pa.list_(pa.string()))], _STATE)

    return run


_STATE = ["block", "state", "cluster", "n", "sums"]


def _last(now: Centroids, dims: int, wide: bool, scale: int):
    def run(batches):
        for batch in batches:
            for i, x, known in _blocks(batch, dims, wide, scale):
                of = now.assign(x, *_pair(known, len(x)))[0]
                distance = [d if d <= _FIT else None for d in map(int, _squares(x, now.at[of]))]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(of, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _bucketed(blocks: DataFrame, bytes_: int) -> DataFrame:
    """The blocks as a table bucketed by block, in the shared folder: joins by block don't shuffle it again."""
    spark = blocks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES))
    name = f"vectors_{uuid.uuid4().hex}"
    blocks.repartition(n, "block").write.bucketBy(n, "block").option("path", new_path(spark, "vectors")).saveAsTable(name)
    return spark.table(name)


def _kept(vectors: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("vector")).where((F.size(v) == dims) & good)


def k_means(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMENSIONS, id_col: str = "vec_id", vector: str = "embedding", salt: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), centroids): every vector's cluster after so many rounds and one more assignment, and the final centroids.

    Vectors count that have `dims` components, none null, not finite or beyond LARGEST; others give no row. Components become
    floor(scale * x). The first centroids are the k vectors whose sha256 of `salt:id` is least (null ids last, then by
    the components). Rows that repeat an id, or all of a row, are vectors of their own. With fewer than k vectors there are as
    many clusters; with none, no row and no centroid. A squared distance beyond 64 bits is null. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)
    id_kind, wide = kind[id_col], kind[vector] != "array<float>"
    kept = _kept(vectors, id_col, vector, dims)
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = kept.select(digest.alias("digest"), F.col("vector").cast("array<double>").alias("vector")).orderBy(F.col("digest").asc_nulls_last(), "vector").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], f"vec_id {id_kind}, cluster int, distance long"), []
    places = [[int(v) for v in row] for row in _whole(np.array([r["vector"] for r in seeds]), scale)]
    packed = kept.mapInArrow(_pack(dims, wide), f"block long, ids array<{id_kind}>, data binary")
    blocks = _bucketed(packed, vectors.count() * dims * (8 if wide else 4))
    now, state = Centroids(places), None

    def beside(columns: list[str]) -> DataFrame:
        some = blocks.select("block", *columns)
        return some if state is None else some.join(state.hint("shuffle_hash"), "block", "left")

    for _ in range(rounds):
        out = staged(beside(["data"]).mapInArrow(_round(now, dims, wide, scale), "block long, state binary, cluster int, n long, sums array<string>"), "round")
        state = out.where("block IS NOT NULL").select("block", "state")
        each = out.where("cluster IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("axis", "sum"))
        sums = each.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
        before, places = places, [list(p) for p in places]
        for r in sums:
            places[r["cluster"]][r["axis"]] = int(r["sum"]) // r["n"]
        now = Centroids(places, before)
    return beside(["ids", "data"]).mapInArrow(_last(now, dims, wide, scale), f"vec_id {id_kind}, cluster int, distance long"), places


def _digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """Every vector's cluster and squared distance, with the inertia of its cluster and of all, and a digest of its centroid; a sum beyond 64 bits is null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, places = k_means(vectors)
    found = staged(found, "clusters")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(whole.alias("inertia")).collect()}  # a row for each cluster
    fits = lambda x: None if x is None or x > _FIT else int(x)
    every = fits(None if None in sums.values() else sum(sums.values()))
    by = spark.createDataFrame([(j, fits(sums[j]), every, _digest(p)) for j, p in enumerate(places) if j in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds unrolled: distances to all centroids, without bounds or balls."""
    kept = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"
    good = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {kept} AS x FROM embeddings WHERE {good})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS}))",
    ]

    def nearest(i: int) -> str:
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return f"a{i} AS MATERIALIZED (SELECT r, any_value(x) AS x, min((d, j)) AS m FROM (SELECT v.r, v.x, c.j, {d} AS d FROM v, c{i} c) GROUP BY r)"

    for i in range(ROUNDS):
        parts.append(nearest(i))
        parts.append(f"s{i} AS (SELECT j, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT m[2] AS j, unnest(range(64)) AS i, unnest(x) AS y FROM a{i}) GROUP BY j, i))")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT j, list(x ORDER BY i) AS x FROM s{i} GROUP BY j) n USING (j))")
    parts.append(nearest(ROUNDS))
    return f"""
WITH {', '.join(parts)}, f AS (SELECT v.vec_id, m[2] AS j, m[1] AS d FROM a{ROUNDS} a JOIN v USING (r))
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c USING (j)
"""


OP11_SQL = _sql()
