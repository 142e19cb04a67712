"""K-means by exponion search against plain k-means on whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import same_rows

from tabweave.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, block long, state string, cluster int, data string"


def plain(rows: list, k: int, rounds: int, scale: int, dims: int):
    """(rows of id, cluster, distance; centroids), every vector being held against all centroids."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < centroids.LARGEST for x in v)]
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    at = [w for _, w in sorted(((name(i), v), w) for (i, v), (_, w) in zip(kept, whole, strict=True))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), j) for j, c in enumerate(at)) for _, w in whole]

    for _ in range(rounds):
        of = [j for _, j in assigned()]
        for j in range(len(at)):
            if own := [w for (_, w), o in zip(whole, of, strict=True) if o == j]:
                at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(whole, assigned(), strict=True)), key=str), at


def rows_of(frame) -> list:
    return sorted(((r.vec_id, r.cluster, r.distance) for r in frame.collect()), key=str)


def some_rows(n: int, dims: int, values, seed: int) -> list:
    r = random.Random(seed)
    return [(i, [float(r.choice(values)) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("values", [[0, 1], [-2, -1, 0, 0.4, 3], [v / 7 for v in range(-40, 40)]])
def test_equals_plain_k_means(spark, values):
    """Few values give many ties; null, short, long and non-finite vectors are left out, repeated rows and ids stay."""
    rows = some_rows(300, 4, values, 1)
    rows += [rows[0], rows[0], (5, rows[9][1]), (None, rows[7][1]), (None, None), (400, []), (401, [1.0] * 5), (402, [1.0, None, 1.0, 1.0]), (403, [1.0, math.nan, 1.0, 1.0]), (404, [math.inf, 0.0, 0.0, 0.0]), (405, [1e30, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "s", 2, "d") for i, v in rows], SCHEMA)
    found, places = centroids.k_means(frame, 6, 5, 8, 4)
    want, at = plain(rows, 6, 5, 8, 4)
    assert found.columns == ["vec_id", "cluster", "distance"] and rows_of(found) == want and places == at


def test_no_and_few_vectors(spark):
    found, places = centroids.k_means(spark.createDataFrame([], SCHEMA), 3, 2, 8, 4)
    assert found.count() == 0 and places == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0])]
    for some in (rows[:1], rows):
        found, places = centroids.k_means(spark.createDataFrame([(*r, 0, "", 0, "") for r in some], SCHEMA), 3, 2, 8, 4)
        want, at = plain(some, 3, 2, 8, 4)
        assert rows_of(found) == want and places == at


def test_large_components(spark):
    """Beyond 64 bits clusters stay exact, and a distance that doesn't fit is null."""
    rows = [(i, [v * 10.0**e for v in (1, 2, -3, i % 4)]) for i, e in enumerate([0, 3, 9, 15, 21, 23] * 5)]
    found, places = centroids.k_means(spark.createDataFrame([(*r, 0, "", 0, "") for r in rows], SCHEMA), 4, 4, 1024, 4)
    want, at = plain(rows, 4, 4, 1024, 4)
    assert places == at and rows_of(found) == sorted(((i, j, d if d < 1 << 63 else None) for i, j, d in want), key=str)
    assert any(r[2] is None for r in rows_of(found))


def test_bounds_and_balls_spare_distances(monkeypatch):
    """Over rounds with real clusters, far fewer distances are computed than vectors times centroids."""
    g = np.random.default_rng(1)
    middles = g.integers(-4000, 4000, (40, 8))
    x = (middles[g.integers(0, 40, 4000)] + g.integers(-200, 200, (4000, 8))).astype(np.int64)
    counted, own = [0], centroids._squares
    places, state, every = x[:40].tolist(), (None, None, None), 0
    now = centroids.Centroids(places)
    monkeypatch.setattr(centroids, "_squares", lambda a, b: (counted.__setitem__(0, counted[0] + len(a)), own(a, b))[1])
    for _ in range(8):
        state = now.assign(x, *state)
        want = own(x[:, None], now.at[None]).argmin(axis=1)
        assert (state[0] == want).all()
        every += 40 * len(x)
        before, places = places, [x[want == j].sum(axis=0) // max(1, (want == j).sum()) if (want == j).any() else np.array(p) for j, p in enumerate(places)]
        places = [[int(v) for v in p] for p in places]
        now = centroids.Centroids(places, before)
    assert counted[0] < 0.35 * every


def test_vectors_are_shuffled_once(spark):
    """A round shuffles the bounds, not the bucketed vectors."""
    frame = spark.createDataFrame([(*r, 0, "", 0, "") for r in some_rows(50, 4, range(9), 2)], SCHEMA)
    plan = centroids.k_means(frame, 3, 2, 8, 4)[0]._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_query(spark, sf, duck):
    same_rows(centroids.op11_centroids(spark, sf).toPandas(), duck.sql(centroids.OP11_SQL).df())
