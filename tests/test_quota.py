"""Budgets of calls by key, over tasks and restarts."""

import time

import pytest
from pyspark.sql import functions as F

from tabweave.streaming import quota


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, quota.STORE)
    yield
    spark.conf.unset(name)


def test_no_key_exceeds_its_budget(spark, store, tmp_path):
    """Three keys, up to 8 tasks, a restart with requests waiting: each request once, and never more than 4 of a key in any 3 seconds."""
    source, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    source.mkdir()

    def put(name: str, ids) -> None:
        (tmp_path / name).write_text("".join(f'{{"request": "r{i}"}}\n' for i in ids))
        (tmp_path / name).rename(source / name)

    def run(until) -> None:
        rows = quota.with_keys(spark.readStream.schema("request string").json(str(source)), ["a", "b", "c"])
        stream = quota.budgeted(rows, 4, 3.0).writeStream.format("json").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(processingTime="300 milliseconds").start()
        end = time.time() + 100
        while stream.isActive and time.time() < end and not until():
            time.sleep(0.3)
        if stream.exception():
            raise stream.exception()
        stream.stop()

    def granted() -> list:
        try:
            return spark.read.schema("key string, request string, granted_at long").json(out).collect()
        except Exception:
            return []

    put("1.json", range(20))
    run(lambda: len(granted()) >= 8)
    before = len(granted())
    assert 8 <= before < 20
    put("2.json", range(20, 30))
    run(lambda: len(granted()) >= 30)
    rows = granted()
    assert sorted(r.request for r in rows) == sorted(f"r{i}" for i in range(30))
    assert {r.key for r in rows} == set("abc")
    for key in "abc":
        at = sorted(r.granted_at for r in rows if r.key == key)
        assert all(b - a >= 3000 for a, b in zip(at, at[4:], strict=False))
    keys = {r.request: r.key for r in quota.with_keys(spark.range(30).select(F.concat(F.lit("r"), "id").alias("request")), ["a", "b", "c"]).collect()}
    assert all(keys[r.request] == r.key for r in rows)
