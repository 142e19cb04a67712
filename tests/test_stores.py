"""Stores over runs: keys, answers and pages."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabweave.sources import stores


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_keys_of_earlier_runs(spark, tmp_path, scheme):
    """Only new rows are shuffled; a run that is done again adds nothing; a store that is opened anew knows its keys."""
    path = f"{scheme}{tmp_path}/keys"
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("hash"), (F.col("id") % 3).alias("n"), F.col("id"))
    store = stores.KeyStore(spark, path, "hash string, n long", buckets=16)
    assert store.unseen(rows(0, 5)).count() == 5
    store.add(rows(0, 300).unionByName(rows(0, 20)))
    store.add(rows(100, 300))
    assert store.seen().count() == 300
    spark.sql(f"DROP TABLE `{store.name}`")  # as in a new session
    again = stores.KeyStore(spark, path)
    assert again.buckets == 16 and sorted(r.id for r in again.unseen(rows(290, 310)).collect()) == list(range(300, 310))
    odd = spark.createDataFrame([("k1", 1), ("k1", 2), (None, 1)], "hash string, n long")
    again.add(odd)
    assert again.seen().count() == 301 and [tuple(r) for r in again.unseen(odd).collect()] == [(None, 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(again.unseen(rows(0, 5)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1 and "Bucketed: true" in text and "SelectedBucketsCount: 16 out of 16" in text


def files(path) -> dict:
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_corrections(spark, tmp_path):
    """Folders without a corrected question keep their files, and the log is the difference of the versions."""
    path = f"{tmp_path}/answers"
    store = stores.AnswerStore(spark, path, parts=10)
    store.create(spark.range(200).select(F.concat(F.lit("q"), "id").alias("question_id"), F.concat(F.lit("a"), "id").alias("answer")).unionByName(spark.createDataFrame([("q0", "a")], "question_id string, answer string")))
    versions, logged = [dict(map(tuple, store.answers().collect()))], 0
    assert len(versions[0]) == 200 and versions[0]["q0"] == "a0"
    for run, some in enumerate([[("q3", "new 3"), ("q4", "a4"), ("none", "x"), ("q5", None), ("q3", "new")], [("q3", "newer"), ("q77", "new 77"), ("q77", "new 77")]]):
        before = files(path)
        store = stores.AnswerStore(spark, path)
        assert store.correct(spark.createDataFrame(some, "question_id string, answer string")) == run
        versions.append(dict(map(tuple, store.answers().collect())))
        changed = {q: (versions[-2][q], a) for q, a in versions[-1].items() if versions[-2][q] != a}
        log = [r for r in store.log().collect() if r.run == run]
        assert {r.question_id: (r.old, r.new) for r in log} == changed and len(log) == len(changed) and all(r["at"] for r in log)
        parts = {r[0] for r in store._rows().where("kind = 'answers'").where(F.col("question_id").isin(list(changed))).select("part").distinct().collect()}
        after = files(path)
        kept = {n for n in before if n in after and before[n] == after[n]}
        assert {n.split("/")[1] for n in set(before) - kept} == {f"part={p}" for p in parts}
        logged += len(log)
    assert versions[-1]["q3"] == "newer" and set(versions[-1]) == set(versions[0]) and store.log().count() == logged == 3
    before = files(path)
    assert store.correct(spark.createDataFrame([("q1", "a1"), ("none", "x")], "question_id string, answer string")) == -1 and files(path) == before


def test_pages(spark, tmp_path):
    """Every page equals the slice of the sorted rows; a late page reads as few files as the first."""
    r = random.Random(3)
    rows = [(r.randrange(300), i) for i in range(1000)] + [(None, 1000)]
    store = stores.Pages(spark, f"{tmp_path}/pages")
    store.build(spark.createDataFrame(rows, "score int, id int"), ["score", "id"], parts=12)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert store.count() == 1001
    for size in (1, 7, 400):
        for k in {0, 1, min(3, 1000 // size), 1000 // size}:
            assert [tuple(x) for x in store.page(k, size).collect()] == want[k * size : (k + 1) * size]
    assert store.page(1001) is None and store.page(143, 7) is None
    read = lambda k: len(store.page(k, 7).inputFiles())
    assert read(0) == 1 and max(read(k) for k in range(0, 140, 9)) <= 2
    none = stores.Pages(spark, f"{tmp_path}/none")
    none.build(spark.createDataFrame([], "score int, id int"), ["score"])
    assert none.count() == 0 and none.page(0) is None
