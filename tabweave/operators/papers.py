"""Tables of papers: from their web page, or from their print where the page has none or can't be had."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import scratch
from . import collect, print_tables, worklists
from .translate import Client

#: What a client for prints answers: words with their boxes and text blocks, by page, as JSON.
PRINT = "struct<words:array<struct<page:int,x1:double,y1:double,x2:double,y2:double,text:string>>,blocks:array<struct<page:int,block:int,x1:double,y1:double,x2:double,y2:double,text:string>>>"
_COLUMNS = ["paper", "origin", "table_no", "caption", "columns", "data"]


def _fetched(rows: DataFrame, address: str, client: Client, out: str, at_once: int | None) -> DataFrame:
    """The rows with what the client gives for an address, null where it fails; kept in the shared folder, so nothing is fetched twice."""
    path = scratch(rows.sparkSession, out)
    worklists.by_client(rows.where(F.col(address).isNotNull()), address, client, out, at_once).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def tables(papers: DataFrame, page: Client, print_: Client, at_once: int | None = None) -> DataFrame:
    """(paper, origin, table_no, caption, columns, data) of (paper, page_url, print_url). page: a client from an address to HTML; print_: from an address to JSON as in PRINT.

    An address that can't be had, or whose answer can't be read, gives no table; prints are fetched only of papers without a table on
    their page. Tables of a print are numbered over its pages; each table is one of at least a header and a row.
    """
    pages = _fetched(papers.select("paper", "page_url"), "page_url", page, "html", at_once)
    on_page = collect.html_tables(pages.where("html IS NOT NULL").select("paper", "html")).withColumn("origin", F.lit("page"))
    kept = scratch(papers.sparkSession, "page_tables")
    on_page.select(*_COLUMNS).write.parquet(kept)
    on_page = papers.sparkSession.read.parquet(kept)
    rest = papers.join(on_page.select("paper").distinct(), "paper", "left_anti").select("paper", "print_url")
    prints = _fetched(rest, "print_url", print_, "print", at_once).select("paper", F.from_json("print", PRINT).alias("p"))
    words = prints.select("paper", F.explode("p.words").alias("w")).select("paper", "w.*")
    blocks = prints.select("paper", F.explode("p.blocks").alias("b")).select("paper", "b.*")
    both = lambda df: df.withColumn("page", F.struct("paper", "page")).drop("paper")  # noqa: E731  captions go by page
    grids = print_tables.captioned(both(print_tables.grid_tables(words, ["paper", "page"])), both(blocks))
    number = F.row_number().over(Window.partitionBy("page.paper").orderBy("page.page", "table_no")) - 1
    printed = grids.select(F.col("page.paper").alias("paper"), F.lit("print").alias("origin"), number.cast("int").alias("table_no"), "caption", "columns", "data")
    return on_page.unionByName(printed)
