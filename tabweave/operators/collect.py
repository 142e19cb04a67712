"""Collection: gates, copies, statistics, CSV and HTML tables, captions, metadata."""

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.batches import parts
from ..sources.stores import KeyStore

DELIMITERS = [",", ";", "\t", "|"]


def gated(tables: DataFrame) -> DataFrame:
    """Tables with whether their source's gate lets them in."""
    ok = F.when(F.col("source") == "github", C.code_host_gate(F.col("columns"), F.col("data"))).otherwise(C.quality_gate(F.col("columns"), F.col("data")))
    return tables.withColumn("accepted", ok)


def distinct_content(tables: DataFrame) -> DataFrame:
    """One table for each source and content, the least id, named by source and hash; headers don't count."""
    by = tables.groupBy("source", C.content_digest(F.col("data")).alias("digest")).agg(F.min("table_id").alias("kept"), F.count("*").alias("copies"))
    return by.withColumn("hash", F.substring("digest", 1, 10)).withColumn("table_id", F.concat_ws("_", "source", "hash")).drop("digest")


def located(kept: DataFrame, files: DataFrame) -> DataFrame:
    """Every kept file name with the first path that it is found at, null if none."""
    first = files.groupBy("file_name").agg(F.min("path").alias("path"))
    return kept.select("file_name").join(first, "file_name", "left")


def new_content(tables: DataFrame, store: KeyStore) -> DataFrame:
    """One table for each source and content that no earlier run has had (store: of `source string, digest string`); those of this run are to be added when it is done."""
    keyed = tables.withColumn("digest", C.content_digest(F.col("data")))
    fresh = store.unseen(keyed.groupBy("source", "digest").agg(F.min("table_id").alias("kept"), F.count("*").alias("copies")))
    return fresh.withColumn("hash", F.substring("digest", 1, 10))


def counted(gated: DataFrame, sources: list[str]) -> tuple[DataFrame, Observation]:
    """The tables, and an observation that has the counters of some sources once the tables are written: they are counted on the way, by no pass of their own."""
    small = (C.dimension(F.col("data")) < 3) | (C.dimension(F.col("columns")) < 3)
    tests = {"seen": F.lit(True), "accepted": F.col("accepted"), "too_small": ~F.col("accepted") & small, "too_empty": ~F.col("accepted") & ~small}
    observation = Observation()
    counts = [F.count_if((F.col("source") == s) & test).alias(f"{name}:{s}") for s in sources for name, test in tests.items()]
    return gated.observe(observation, *counts), observation


def observed_counters(observation: Observation, spark: SparkSession) -> DataFrame:
    """(source, seen, accepted, too_small, too_empty) of an observation whose tables are written; sources without a table are left out."""
    rows: dict[str, dict] = {}
    for name, n in observation.get.items():
        counter, source = name.split(":", 1)
        rows.setdefault(source, {})[counter] = n
    return spark.createDataFrame([(s, *(c[k] for k in ("seen", "accepted", "too_small", "too_empty"))) for s, c in rows.items() if c["seen"]], "source string, seen long, accepted long, too_small long, too_empty long")


def counters(gated: DataFrame) -> DataFrame:
    """By source: tables seen, let in, and turned away for size or for nulls."""
    small = (C.dimension(F.col("data")) < 3) | (C.dimension(F.col("columns")) < 3)
    return gated.groupBy("source").agg(F.count("*").alias("seen"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted") & small).alias("too_small"), F.count_if(~F.col("accepted") & ~small).alias("too_empty"))


def clean_headers(columns):
    """Headers of printed tables: line breaks become spaces, null an empty text."""
    return F.transform(columns, lambda c: F.coalesce(F.trim(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit("")))


def first_tables(from_html: DataFrame, from_print: DataFrame, key: str = "paper") -> DataFrame:
    """Tables read from a paper's page; those of its print only where the page has none."""
    return from_html.unionByName(from_print.join(from_html.select(key).distinct(), key, "left_anti"))


def query_text(terms: list[str], size: tuple[int, int], ending: str = "csv") -> str:
    """A code search for any of some terms in files of an ending and a size range in bytes."""
    return f"({' OR '.join(terms)}) extension:{ending} size:{size[0]}..{size[1]}"


def up_to(tables: DataFrame, target: int) -> DataFrame:
    """At most `target` tables of each source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("table_id"))
    return tables.withColumn("rank", rank).where(F.col("rank") <= target).drop("rank")


def missing_tables(tables: DataFrame, blank: bool = False) -> DataFrame:
    return tables.where(C.has_missing(F.col("data"), blank))


def complete_tables(tables: DataFrame, blank: bool = False) -> DataFrame:
    return tables.where(~C.has_missing(F.col("data"), blank))


def with_metadata(tables: DataFrame, metadata: DataFrame, key: str = "table_id") -> DataFrame:
    return tables.join(metadata.withColumn("has_metadata", F.lit(True)), key, "left").withColumn("has_metadata", F.coalesce("has_metadata", F.lit(False)))


def metadata_by_hash(tables: DataFrame, stems: DataFrame) -> DataFrame:
    """(hash, stem): for each hash the first stem that contains it, null if none.

    Stems are cut into all their parts of the lengths that hashes have, so this is an equality join.
    """
    lengths = [r[0] for r in tables.select(F.length("hash")).distinct().collect()]
    pieces = F.concat(F.array().cast("array<string>"), *(_parts(n) for n in lengths))
    cut = stems.select("stem", F.explode(F.array_distinct(pieces)).alias("hash"))
    return tables.select("hash").distinct().join(cut, "hash", "left").groupBy("hash").agg(F.min("stem").alias("stem"))


def _parts(n: int):
    begins = F.sequence(F.lit(1), F.greatest(F.length("stem") - (n - 1), F.lit(1)))
    return F.filter(F.transform(begins, lambda i: F.substr("stem", i, F.lit(n))), lambda x: F.length(x) == n)


# Names of column types, from the narrowest on.
_WHOLE, _REAL, _TRUTH, _OTHER = "int64", "float64", "bool", "object"


def column_types(data: Column, width: Column) -> Column:
    """The type of each column of texts: the least that all its cells have. Nulls (and short rows) make whole numbers real and truths others; a column of nulls is real."""

    def of(j: Column) -> Column:
        cells = F.transform(data, lambda r: F.get(r, j))
        there = F.filter(cells, lambda c: c.isNotNull())
        full = F.size(there) == F.size(cells)
        whole = F.forall(there, lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull())
        real = F.forall(there, lambda c: c.try_cast("double").isNotNull())
        truth = F.forall(there, lambda c: c.isin("True", "False"))
        return F.when(F.size(there) == 0, F.when(F.size(cells) == 0, _OTHER).otherwise(_REAL)).when(whole, F.when(full, _WHOLE).otherwise(_REAL)).when(real, _REAL).when(truth & full, _TRUTH).otherwise(_OTHER)

    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), of)).otherwise(F.array().cast("array<string>"))


def table_statistics(tables: DataFrame) -> DataFrame:
    """Rows, columns and cells; columns of numbers and of others with the numeric share; the first 20 names, and each name's type (of names that repeat, the last's)."""
    rows = tables.withColumn("types", column_types(F.col("data"), F.size("columns")))
    count = lambda keep: F.size(F.filter("types", keep)).cast("long")
    width = F.size("columns")
    numeric = count(lambda t: t.isin(_WHOLE, _REAL))
    names = F.transform("columns", lambda c: F.coalesce(c, F.lit("")))
    last = F.filter(F.arrays_zip(names.alias("name"), F.col("types").alias("type"), F.sequence(F.lit(1), width).alias("at")), lambda x: x["at"] == width + 1 - F.array_position(F.reverse(names), x["name"]))
    return rows.select(
        "table_id", C.dimension(F.col("data")).alias("num_rows"), width.cast("long").alias("total_columns"), (C.dimension(F.col("data")) * width).alias("num_cells"),
        numeric.alias("numeric_columns"), count(lambda t: t == _OTHER).alias("text_columns"), F.when(width > 0, F.round(numeric * 1.0 / width, 4)).otherwise(0.0).alias("numeric_share"),
        F.slice("columns", 1, 20).alias("column_names"), F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["type"]))).alias("data_types"),
    )


def _csv_rows(content):
    """The rows of a CSV text: line breaks within quotes part none; blank lines are left out."""
    rows = F.regexp_extract_all(F.regexp_replace(content, "\r\n?", "\n"), F.lit(r'(?:[^"\n]++|"(?:[^"]++|"")*+"|")++'), F.lit(0))
    return F.filter(rows, lambda x: F.trim(x) != "")


def _csv_fields(row, delimiter: str):
    """The fields of a row; quoted ones hold delimiters, and quotes doubled."""
    d = rf"\Q{delimiter}\E"
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter), row), F.lit(rf'{d}("(?:[^"]++|"")*+"|(?:(?!{d}).)*+)'), F.lit(1))
    return F.transform(fields, lambda x: F.when(x.rlike('(?s)^".*"$'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def sniff_csv(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds delimiter, columns and data: the first delimiter that parts the header; rows with more fields are left out.

    An empty header is named by its place, an empty field and one that a short row lacks are null. Without a delimiter
    columns and data are null.
    """
    rows = files.withColumn("lines", _csv_rows(F.col(content)))
    heads = [_csv_fields(F.get("lines", F.lit(0)), d) for d in DELIMITERS]
    rows = rows.withColumn("delimiter", F.coalesce(*(F.when(F.size(h) > 1, d) for h, d in zip(heads, DELIMITERS, strict=True))))
    parts = F.coalesce(*(F.when(F.col("delimiter") == d, F.transform("lines", _fields_by(d))) for d in DELIMITERS))
    rows = rows.withColumn("parts", parts)
    named = F.transform(F.get("parts", F.lit(0)), lambda x, i: F.when(x == "", F.concat(F.lit("Unnamed: "), i)).otherwise(x))
    fits = F.filter(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda r: F.size(r) <= F.size("columns"))
    whole = F.transform(fits, lambda r: F.transform(F.sequence(F.lit(0), F.size("columns") - 1), lambda j: F.nullif(F.get(r, j), F.lit(""))))
    return rows.withColumn("columns", named).withColumn("data", F.when(F.col("columns").isNotNull(), whole)).drop("lines", "parts")


def _fields_by(delimiter: str):
    return lambda row: _csv_fields(row, delimiter)


_EMPTY = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


class _Element:
    def __init__(self, tag: str, classes: list, parent: "_Element | None"):
        self.tag, self.classes, self.parent, self.inside = tag, classes, parent, []

    def text(self) -> str:
        return "".join(x.strip() if isinstance(x, str) else x.text() for x in self.inside)

    def all(self, *tags: str) -> list:
        """Descendants of these tags, in order; those of a table within are its own."""
        out = []
        for x in self.inside:
            if isinstance(x, _Element):
                out += [x] if x.tag in tags else []
                out += [] if x.tag == "table" else x.all(*tags)
        return out


#: A tag as pages mostly have it, with the text after it; and its attributes. The parser reads a page that holds anything else, or one of the elements whose text isn't markup.
_TAG = re.compile(r"""<(?:([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z0-9-]*(?:=(?:"[^"]*"|'[^']*'|[a-zA-Z0-9]+))?)*)\s*|/([a-zA-Z][a-zA-Z0-9]*))>([^<]*)""")
_ATTRIBUTE = re.compile(r"""\s+([a-zA-Z][a-zA-Z0-9-]*)(?:=(?:"([^"]*)"|'([^']*)'|([a-zA-Z0-9]+)))?""")
_OTHER_TEXT = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title", "plaintext", "noscript"}


class _Page(HTMLParser):
    """A page's elements, and its tables in order."""

    def __init__(self, html: str):
        self.at, self.tables = _Element("", [], None), []
        if not self.plain(html):
            super().__init__()
            self.feed(html)

    def plain(self, html: str) -> bool:
        """Reads a page of nothing but tags and texts; of others nothing is read."""
        begin = html.find("<")
        if begin < 0 or "&" in html[html.rfind(">") :]:
            return False
        tags, at = [], begin
        while at < len(html):
            if (tag := _TAG.match(html, at)) is None or (tag[1] or "").lower() in _OTHER_TEXT:
                return False
            tags.append(tag.groups())
            at = tag.end()
        if begin:
            self.handle_data(unescape(html[:begin]))
        for name, attributes, ending, text in tags:
            if ending is not None:
                self.handle_endtag(ending.lower())
            else:
                found = [(a.lower(), unescape(b or c or d)) for a, b, c, d in _ATTRIBUTE.findall(attributes)] if "class" in attributes.lower() else ()
                self.handle_starttag(name.lower(), found)
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
        return True

    def handle_starttag(self, tag, attrs):
        new = _Element(tag, (dict(attrs).get("class") or "").split(), self.at)
        self.at.inside.append(new)
        if tag == "table":
            self.tables.append(new)
        if tag not in _EMPTY:
            self.at = new

    def handle_data(self, data):
        self.at.inside.append(data)

    def handle_endtag(self, tag):
        up = self.at
        while up and up.tag != tag:
            up = up.parent
        if up:
            self.at = up.parent


def _caption(table: _Element) -> str:
    """Its own caption; else that of the element just before it, if that is one; else that of the figure it stands in."""
    if own := table.all("caption"):
        return own[0].text()
    before = [x for x in table.parent.inside[: table.parent.inside.index(table)] if isinstance(x, _Element)][-1:]
    said = before[0].text() if before and (before[0].tag in ("figcaption", "caption") or "caption" in before[0].classes) else ""
    figure = table.parent
    while figure and figure.tag != "figure":
        figure = figure.parent
    return said or (figure.all("figcaption")[0].text() if figure and figure.all("figcaption") else "")


def _grid(table: _Element) -> tuple[list, list]:
    """Header and data rows: the header is the first row of thead, or a first row of th alone; without either, columns are numbered."""
    rows = [(row, [x for x in row.inside if isinstance(x, _Element) and x.tag in ("td", "th")]) for row in table.all("tr")]
    rows = [(row, cells) for row, cells in rows if cells]
    data = [[" ".join(c.text().split()) for c in cells] for _, cells in rows]
    if rows and (rows[0][0].parent.tag == "thead" or all(c.tag == "th" for c in rows[0][1])):
        return data[0], data[1:]
    return [str(i) for i in range(max(map(len, data), default=0))], data


_TABLES = pa.list_(pa.struct([("table_no", pa.int32()), ("caption", pa.string()), ("columns", pa.list_(pa.string())), ("data", pa.list_(pa.list_(pa.string())))]))
#: Bytes of pages whose elements are held at once, unless a page has more.
MOST_HELD = 1 << 22


def _tables(html: str) -> list[dict]:
    """The tables of a page that have data."""
    grids = [(i, table, *_grid(table)) for i, table in enumerate(_Page(html or "").tables)]
    return [{"table_no": i, "caption": _caption(table), "columns": columns, "data": data} for i, table, columns, data in grids if data]


def _page_tables(pages: pa.Array) -> pa.Array:
    sizes = pa.compute.binary_length(pages).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.concat_arrays([pa.array([_tables(x) if x else [] for x in pages.slice(i, j - i).to_pylist()], _TABLES) for i, j in parts(sizes, MOST_HELD)])


def html_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that hold a table element, with the tables; the text of others never reaches Python."""
    rest = [c for c in pages.columns if c != html]
    tables = F.arrow_udf(_page_tables, "array<struct<table_no:int,caption:string,columns:array<string>,data:array<array<string>>>>")
    some = F.when(F.lower(html).contains("<table"), F.col(html))  # no filter, as one would go to where the pages are made
    return pages.select(*rest, tables(some).alias("_tables")).select(*rest, F.inline_outer("_tables")).where("table_no IS NOT NULL")  # an outer one, as Spark would test the array of an inner one first, which computes it again


def stands_above(block: Column | dict[str, Column], x1: Column, y1: Column) -> Column:
    """Whether a text block (x1, y1, y2, text) ends above a table's upper left corner, begins within 100 points of it and 50 of its left edge, and speaks of a table."""
    return (block["y2"] <= y1) & (block["y1"] >= y1 - 100) & (F.abs(block["x1"] - x1) < 50) & F.lower(F.substring(block["text"], 1, 20)).rlike(r"table|tab\.|tab:")


def captions(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first text block of the page that is above a table.

    An equality join on the page; the ranges are tested on its few blocks.
    """
    near = stands_above({c: F.col(f"b.{c}") for c in ("x1", "y1", "y2", "text")}, F.col("t.x1"), F.col("t.y1"))
    joined = tables.alias("t").join(blocks.alias("b"), (F.col("t.page") == F.col("b.page")) & near)
    return joined.groupBy(F.col("t.page").alias("page"), F.col("t.table_no").alias("table_no")).agg(F.min_by("b.text", "b.block").alias("caption"))
