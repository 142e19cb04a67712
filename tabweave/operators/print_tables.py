"""Tables of printed pages, recovered from words and their boxes.

Words whose boxes overlap in height are a line; words of a line that stand close are one text. Lines of two texts or more that follow
each other closely are a table. The fullest of its lines tell its columns: the stretches of the page's width that their texts cover, parted by
gaps that none of them covers. All steps are windows within a page, so a page's words are shuffled once, into as many partitions as the
number of words asks for. Windows that follow each other share a sort where they can.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .collect import clean_headers, stands_above

#: Gap between words, and between lines, in heights of a line, from which on they belong to different texts and tables.
WORD_GAP, LINE_GAP = 0.8, 1.5
#: Words of one task, as every sort of a task holds them.
TASK_WORDS = 200_000


def _islands(new: Column, window) -> Column:
    """Number, from 0, of the run that a row is in, where new tells whether it begins one; null counts as so."""
    return F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def spread(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The words by page, in partitions of some TASK_WORDS each (they are counted), so that a task's memory doesn't grow with their number."""
    some = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS))
    return words.repartition(some, *keys)


def texts(words: DataFrame, keys: Sequence[str] = ("page",), word_gap: float = WORD_GAP) -> DataFrame:
    """(*keys, line, at, x1, y1, x2, y2, text): words (x1, y1, x2, y2, text) joined to texts by line; y grows downwards. Words without a box or text are left out."""
    keys, boxes = list(keys), [F.col(c).isNotNull() for c in ("x1", "y1", "x2", "y2")]
    rows = words.where(boxes[0] & boxes[1] & boxes[2] & boxes[3] & (F.trim("text") != "")).select(*keys, *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.trim("text").alias("text"))
    middle = (F.col("y1") + F.col("y2")) / 2
    down = Window.partitionBy(*keys).orderBy(middle, "x1", "x2", "text")
    lined = rows.withColumn("line", _islands(F.col("y1") > F.max(middle).over(_before(down)), down))
    along = Window.partitionBy(*keys, "line").orderBy("x1", "x2", "text")
    gap = F.col("x1") - F.max("x2").over(_before(along))
    placed = lined.withColumn("at", _islands(gap > word_gap * (F.col("y2") - F.col("y1")), along))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "x2", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*keys, "line", "at").agg(F.min("x1").alias("least"), F.min("y1").alias("top"), F.max("x2").alias("most"), F.max("y2").alias("bottom"), said.alias("text")).select(*keys, "line", "at", F.col("least").alias("x1"), F.col("top").alias("y1"), F.col("most").alias("x2"), F.col("bottom").alias("y2"), "text")


def grid_tables(words: DataFrame, keys: Sequence[str] = ("page",), word_gap: float = WORD_GAP, line_gap: float = LINE_GAP) -> DataFrame:
    """(*keys, table_no, x1, y1, x2, y2, columns, data): the tables of every page, numbered from 0 downwards.

    The first line is the header; a table of a header alone is none. A place without text is null in the data, empty in the header; texts of one line
    in the same column are joined. A line of one text ends a table. A page without tables, or without words, gives no row.
    """
    keys, whole = list(keys), (Window.unboundedPreceding, Window.unboundedFollowing)
    some = texts(spread(words, keys), keys, word_gap)
    line = Window.partitionBy(*keys, "line").orderBy("at").rowsBetween(*whole)  # ordered, as the windows after it need
    sized = some.withColumns({"texts": F.count("*").over(line), "top": F.min("y1").over(line), "bottom": F.max("y2").over(line)})
    above = Window.partitionBy(*keys).orderBy("line").rangeBetween(-1, -1)
    near = F.col("top") - F.max("bottom").over(above) <= line_gap * (F.col("bottom") - F.col("top"))
    begins = (F.col("at") == 0) & ~F.coalesce(near & (F.col("texts") > 1) & (F.max("texts").over(above) > 1), F.lit(False))
    blocks = sized.withColumn("block", _islands(begins, Window.partitionBy(*keys).orderBy("line", "at"))).where("texts > 1")
    own = Window.partitionBy(*keys, "block")
    cells = blocks.withColumn("full", F.col("texts") == F.max("texts").over(own.orderBy("texts", "x1", "x2", "line").rowsBetween(*whole)))
    # where the full lines' texts leave a gap across the page, the right edge of those before it
    across = Window.partitionBy(*keys, "block", "texts").orderBy("x1", "x2", "line")
    marked = cells.withColumn("before", F.max("x2").over(_before(across)))
    placed = marked.withColumn("edges", F.collect_set(F.when(F.col("full") & (F.col("x1") > F.col("before")), F.col("before"))).over(own))
    placed = placed.withColumns({"column": F.size(F.filter("edges", lambda e: e < F.col("x1"))), "width": F.size("edges") + 1})
    box = lambda c: [F.min(c("x1")).alias("x1"), F.min(c("y1")).alias("y1"), F.max(c("x2")).alias("x2"), F.max(c("y2")).alias("y2")]
    rows = placed.groupBy(*keys, "block", "line", "width").agg(F.array_sort(F.collect_list(F.struct("column", "at", "text"))).alias("texts"), F.struct(*box(F.col)).alias("box"))
    words_of = lambda i: F.array_join(F.transform(F.filter("texts", lambda t: t["column"] == i), lambda t: t["text"]), " ")
    cell = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.nullif(words_of(i), F.lit("")))
    tables = rows.select(*keys, "block", "line", "box", cell.alias("row")).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("line", "row"))).alias("rows"), F.struct(*box(lambda c: F.col(f"box.{c}"))).alias("box"))
    tables = tables.where(F.size("rows") > 1)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1
    data = F.transform(F.slice("rows", F.lit(2), F.size("rows") - 1), lambda r: r["row"])
    return tables.select(*keys, number.alias("table_no"), "box.*", clean_headers(F.col("rows")[0]["row"]).alias("columns"), data.alias("data"))


def captioned(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tables of pages (one key, `page`) with the caption that a text block (page, block, x1, y1, x2, y2, text) above them gives; empty where none does.

    A page's few blocks come to its tables, so these are computed once.
    """
    of_page = blocks.where("block IS NOT NULL").groupBy("page").agg(F.collect_list(F.struct("block", "x1", "y1", "y2", "text")).alias("blocks"))
    said = F.array_min(F.transform(F.filter("blocks", lambda b: stands_above(b, F.col("x1"), F.col("y1"))), lambda b: F.struct(b["block"], b["text"])))["text"]
    return tables.join(of_page, "page", "left").withColumn("caption", F.coalesce(said, F.lit(""))).drop("blocks")
