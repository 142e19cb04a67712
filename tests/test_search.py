"""Searches: narrowing, and streams that stop and go on."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tabweave.sources import search


def test_filters_narrow_the_search(spark):
    """Categories and dates reach the client; rows are filtered by Spark all the same."""
    spark.dataSource.register(search.SearchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("paged_search").options(terms="a,b", client="tests.clients:find_papers", fields=search.PAPERS, narrow="category,submitted", order="relevance").load()
        got = rows.where("category IN ('cs.CL', 'cs.AI') AND submitted >= '2021-01-01' AND submitted < '2022-06-01' AND title <> ''").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r.entry for r in got) == sorted(f"{t}/{i}" for t in "ab" for i in range(12) if i % 2 and i % 3)
    assert all(r.title.startswith("relevance") and "('in', ['cs.CL', 'cs.AI'])" in r.title and "from" in r.title and "to" in r.title for r in got)
    assert rows.count() == 24


@pytest.mark.parametrize("target, want", [(None, ["a1", "a2", "b1", "b2"]), (7, ["a1", "a2", "b1"])])
def test_a_stopped_stream_goes_on(spark, tmp_path, target, want):
    """The client fails on the second page; the next run asks for that page and none before. Three empty pages end a term."""
    out, calls = f"{tmp_path}/out", tmp_path / "calls"
    hits = lambda: search.stream(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "tests.clients:find_or_fail", pages=7, **({"target": target} if target else {}))
    (tmp_path / "down").touch()
    run = search.collect_hits(hits(), lambda df: df.withColumn("seen", F.lit(1)), out, f"{tmp_path}/check")
    with pytest.raises(StreamingQueryException):
        run.processAllAvailable()
    run.stop()
    assert calls.read_text() == "a1 "
    (tmp_path / "down").unlink()
    calls.write_text("")
    run = search.collect_hits(hits(), lambda df: df.withColumn("seen", F.lit(1)), out, f"{tmp_path}/check")
    run.processAllAvailable()
    run.stop()
    rows = [f"{r.owner}{r.repo}" for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == sorted(3 * want) and calls.read_text().split()[:5] == ["a2", "a3", "a4", "a5", "b1"]


def test_paper_query():
    got = search.paper_query([(["survey", "review"], ["comparative study"]), ([], ["dataset analysis"])], ["cs.CL", "q-fin.*"], ("20210101", "20250930"))
    assert got == '((ti:("survey" OR "review") OR abs:("comparative study")) OR (abs:("dataset analysis"))) AND (cat:cs.CL OR cat:q-fin.*) AND (submittedDate:[20210101 TO 20250930])'
