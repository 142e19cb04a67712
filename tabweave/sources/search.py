"""A paged search as a Spark source: read at once, a term a partition, or as a stream that goes on where it stopped."""

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

#: Empty pages in a row that end a term.
EMPTY = 3
HITS = "owner string, repo string, path string"
PAPERS = "entry string, title string, category string, submitted date"


class SearchSource(DataSource):
    """Rows of (term, page, *fields).

    Options: terms (comma-separated), pages (10), client (module:function), fields (HITS; PAPERS for a search of papers), narrow
    (comma-separated fields by which the client can
    narrow its search; needs spark.sql.python.filterPushdown.enabled), order (told to the client), target. The client is a
    function of term and page, and of `narrow` and `order` if these are given, to a list of rows. EMPTY empty pages in a row end a
    term; the next one follows. A stream takes one page a batch, and no page after the one with which `target` rows are there; a batch
    read has no target, as its terms are read side by side. Register with spark.dataSource.register.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return f"term string, page int, {self.options.get('fields', HITS)}"

    def reader(self, schema) -> DataSourceReader:
        return (_NarrowedReader if "narrow" in self.options else _BatchReader)(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


class _Search:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.terms = self.options["terms"].split(",")
        self.pages = int(self.options.get("pages", 10))
        self.narrow: dict[str, dict] = {}

    def find(self, term: str, page: int) -> list[tuple]:
        module, name = self.options["client"].split(":")
        more = {k: v for k, v in (("narrow", self.narrow), ("order", self.options.get("order"))) if v}
        return [(term, page, *row) for row in getattr(importlib.import_module(module), name)(term, page, **more)]


_TESTS: dict[type, str] = {EqualTo: "in", In: "in", GreaterThan: "from", GreaterThanOrEqual: "from", LessThan: "to", LessThanOrEqual: "to"}


class _BatchReader(_Search, DataSourceReader):
    def partitions(self):
        return [InputPartition(t) for t in self.terms]

    def read(self, partition) -> Iterator[tuple]:
        empty = 0
        for page in range(1, self.pages + 1):
            rows = self.find(partition.value, page)
            empty = 0 if rows else empty + 1
            if empty == EMPTY:
                return
            yield from rows


class _NarrowedReader(_BatchReader):
    def pushFilters(self, filters):  # noqa: N802
        """Values and bounds of fields that the client can narrow by; Spark still tests all filters, so a client may give more."""
        able = [c for c in self.options.get("narrow", "").split(",") if c]
        for f in filters:
            if (kind := _TESTS.get(type(f))) and len(f.attribute) == 1 and f.attribute[0] in able:
                own = self.narrow.setdefault(f.attribute[0], {})
                if kind == "in":
                    values = list(f.value) if isinstance(f, In) else [f.value]
                    own["in"] = [v for v in values if v in own.get("in", values)]
                else:
                    own[kind] = (max if kind == "from" else min)(f.value, own.get(kind, f.value))
            yield f


class _StreamReader(_Search, SimpleDataSourceStreamReader):
    """Offsets name the next page: (term, page, empty pages before it, rows so far). A batch is a page, so the driver holds that page's hits alone."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"term": 0, "page": 1, "empty": 0, "found": 0}

    def read(self, start: dict):
        target = self.options.get("target")
        while start["term"] < len(self.terms) and not (target and start["found"] >= int(target)):
            rows = self.find(self.terms[start["term"]], start["page"])
            empty = 0 if rows else start["empty"] + 1
            over = empty == EMPTY or start["page"] >= self.pages
            start = {"term": start["term"] + over, "page": 1 if over else start["page"] + 1, "empty": 0 if over else empty, "found": start["found"] + len(rows)}
            if rows:
                return iter(rows), start
        return iter([]), start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """Asks for the same pages again, after a restart."""
        while start != end:
            rows, after = self.read(start)
            yield from rows
            if after == start:
                return
            start = after


def stream(spark: SparkSession, terms: list[str], client: str, **options) -> DataFrame:
    """The search as a stream. What follows it (downloads, parsing) runs on all machines; an error of the client ends the run, and the next one goes on at that page."""
    spark.dataSource.register(SearchSource)
    reader = spark.readStream.format("paged_search").option("terms", ",".join(terms)).option("client", client)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def collect_hits(hits: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Starts a run of the stream through `work` into Parquet; each batch has a folder of its own, which a repeated batch overwrites."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def paper_query(groups: list[tuple[list[str], list[str]]], categories: list[str], dates: tuple[str, str]) -> str:
    """A paper search: any of some groups (phrases in the title, phrases in the abstract), any of some categories, submitted between two days (YYYYMMDD)."""
    either = lambda field, phrases: f"{field}:({' OR '.join(f'"{p}"' for p in phrases)})"
    themes = " OR ".join("(" + " OR ".join(either(f, p) for f, p in zip(("ti", "abs"), g, strict=True) if p) + ")" for g in groups)
    return f"({themes}) AND ({' OR '.join(f'cat:{c}' for c in categories)}) AND (submittedDate:[{dates[0]} TO {dates[1]}])"
