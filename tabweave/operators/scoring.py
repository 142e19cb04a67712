"""Translatability of tables, terms, and selection of the best tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import terms as E
from ..functions import text as T


def cells(tables: DataFrame) -> DataFrame:
    """The long form: table_id, category, row_idx, col_idx, col_name, cell, and kind if the tables have kinds.

    Explodes are outer ones, as Spark tests the array of an inner one for emptiness first, which computes it again.
    """
    typed = "kinds" in tables.columns
    data = F.arrays_zip(F.col("data").alias("row"), F.col("kinds").alias("kinds")) if typed else F.col("data")
    rows = tables.select("table_id", "category", "columns", F.posexplode_outer(data).alias("row_idx", "row"))
    row = F.arrays_zip(F.col("row.row").alias("cell"), F.col("row.kinds").alias("kind")) if typed else F.col("row")
    flat = rows.select("table_id", "category", "columns", "row_idx", F.posexplode_outer(row).alias("col_idx", "cell")).where("col_idx IS NOT NULL")
    cell = [F.col("cell.cell").alias("cell"), F.col("cell.kind").alias("kind")] if typed else ["cell"]
    return flat.select("table_id", "category", "row_idx", "col_idx", F.get("columns", F.col("col_idx")).alias("col_name"), *cell)


def from_cells(cells: DataFrame) -> DataFrame:
    """Tables back from the long form: rows and cells in their order; a table comes together in one row, as it is stored."""
    rows = cells.groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "cell"))), lambda x: F.struct(x["col_name"].alias("name"), x["cell"].alias("cell"))).alias("r"))
    tables = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "r"))).alias("rows"))
    return tables.select("table_id", F.transform(F.get("rows", F.lit(0))["r"], lambda x: x["name"]).alias("columns"), F.transform("rows", lambda x: F.transform(x["r"], lambda y: y["cell"])).alias("data"))


def dictionary(spark: SparkSession, translatable: list[str] = C.TRANSLATABLE, untranslatable: list[str] = C.UNTRANSLATABLE) -> DataFrame:
    """(term, label) of two lists, to be learnt on from; a term of both is untranslatable."""
    labels = {t: label for label, terms in (("translatable", translatable), ("untranslatable", untranslatable)) for t in terms}
    return spark.createDataFrame(sorted(labels.items()), "term string, label string")


def _untranslatable(terms: DataFrame | list[str]) -> DataFrame | list[str]:
    return terms.where("label = 'untranslatable'") if isinstance(terms, DataFrame) and "label" in terms.columns else terms


def cell_translatability(cells: DataFrame, terms: DataFrame | list[str] = C.UNTRANSLATABLE) -> DataFrame:
    """The cells with score and reason. terms: a list, or a dictionary (term, and label if it holds others than untranslatable ones) of any size."""
    kind = F.col("kind") if "kind" in cells.columns else None
    rows = E.with_found(cells, _untranslatable(terms), "cell", "_found")
    return rows.withColumn("_t", C.translatability(F.col("cell"), kind=kind, found=F.col("_found"))).select(*cells.columns, F.col("_t.score").alias("score"), F.col("_t.reason").alias("reason"))


def _points(cell: Column, kind: Column | None, found: Column) -> Column:
    return F.round(C.translatability(cell, kind=kind, found=found)["score"] * 100).cast("int")


def table_translatability(tables: DataFrame, terms: DataFrame | list[str] = C.UNTRANSLATABLE) -> DataFrame:
    """Counts by band and the mean score; tables of at most one data row have zeros. terms as in cell_translatability.

    Scores stay in their table's row, so nothing is shuffled; for a dictionary too large to be broadcast, cells are joined to it.
    """
    terms, typed = _untranslatable(terms), "kinds" in tables.columns
    if isinstance(terms, DataFrame) and not E.few(terms):
        each = F.posexplode_outer(F.arrays_zip(F.flatten("data").alias("cell"), F.flatten("kinds").alias("kind")) if typed else F.transform(F.flatten("data"), lambda c: F.struct(c.alias("cell"))))
        rows = tables.select("table_id", "category", F.size("data").alias("n"), each.alias("at", "x"))
        flat = E.with_found(rows.where("n > 1 AND at IS NOT NULL").select("table_id", "at", "x.*"), terms, "cell", "found")
        points = flat.select("table_id", "at", _points(F.col("cell"), F.col("kind") if typed else None, F.col("found")).alias("s")).groupBy("table_id").agg(F.collect_list("s").alias("s"))
        rows = tables.select("table_id", "category").join(points, "table_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<int>"))).withColumn("n", F.size("s"))
    else:
        cells = F.flatten("data")
        both = F.arrays_zip(cells.alias("cell"), F.flatten("kinds").alias("kind")) if typed else F.transform(cells, lambda c: F.struct(c.alias("cell"), F.lit(None).cast("string").alias("kind")))
        some = tables.select("table_id", "category", F.when(F.size("data") > 1, both).otherwise(F.array().cast("array<struct<cell:string,kind:string>>")).alias("cells"))
        found = some.withColumn("found", E.scanner(terms)(F.col("cells.cell"), many=True))
        rows = found.select("table_id", "category", F.size("cells").alias("n"), F.zip_with("cells", "found", lambda c, f: _points(c["cell"], c["kind"] if typed else None, f)).alias("s"))
    count = lambda keep: F.size(F.filter("s", keep)).cast("long")
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "table_id", "category",
        F.col("n").cast("long").alias("total_cells"),  # not of s, as Spark would scan the cells a second time for a filter on it
        count(lambda x: x >= 70).alias("cells_maintaining_meaning"),
        count(lambda x: x < 30).alias("cells_losing_meaning"),
        count(lambda x: (x >= 30) & (x < 70)).alias("cells_partially_translatable"),
        F.when(F.size("s") > 0, F.round(total / 100.0 / F.size("s"), 2)).otherwise(0.0).alias("average_translatability"),
        count(lambda x: x == 0).alias("untranslatable_count"),
    )


def table_scores(analysis: DataFrame) -> DataFrame:
    """Score from 1 to 10 of each table, rounded half to even."""
    ratio = F.col("cells_maintaining_meaning") / F.col("total_cells")
    raw = F.least(F.lit(10.0), ratio / 0.7 * 10) * 0.7 + F.col("average_translatability") * 10 * 0.3
    score = F.when(F.col("total_cells") == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.bround(raw).cast("int"))))
    return analysis.select("table_id", "category", score.cast("int").alias("score"))


def score_distribution(scores: DataFrame) -> DataFrame:
    """Tables of each score from 1 to 10, by category; zero where there is none."""
    counts = scores.groupBy("category").agg(*(F.count_if(F.col("score") == i).alias(str(i)) for i in range(1, 11)))
    return counts.select("category", F.explode(F.map_from_arrays(F.array(*(F.lit(i) for i in range(1, 11))), F.array(*(F.col(str(i)) for i in range(1, 11))))).alias("score", "tables"))


def category_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("category").agg(F.count("*").alias("total_tables"), F.round(F.avg("score"), 2).alias("average_score"))


def _text_cells(tables: DataFrame) -> DataFrame:
    texts = F.flatten("data")
    if "kinds" in tables.columns:
        texts = F.zip_with(texts, F.flatten("kinds"), lambda c, k: F.when(k == "text", c))
    return tables.select(F.explode_outer(texts).alias("cell")).where(~(C.is_numeric(F.col("cell")) | C.is_path(F.col("cell"))))


def distinct_terms(tables: DataFrame, with_phrases: bool = False) -> DataFrame:
    """Words (and phrases) of text cells that are terms."""
    found = T.words(F.col("cell"))
    if with_phrases:
        found = F.concat(found, T.phrases(F.col("cell")))
    return _text_cells(tables).select(F.explode(found).alias("term")).where(T.is_term(F.col("term"))).distinct()


def unknown_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Terms that the dictionary (term, label) lacks."""
    return terms.join(known, "term", "left_anti")


def learn_terms(known: DataFrame, labelled: DataFrame) -> DataFrame:
    """The dictionary with newly labelled terms; a term that is there keeps its label."""
    return known.unionByName(labelled.join(known, "term", "left_anti").dropDuplicates(["term"]))


def term_frequency(tables: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Occurrences of (label, term) in the text cells of tables with more than one row: words of three letters or more that the dictionary (term, label) has, else the least untranslatable term of several words that the cell holds, else the word as unknown."""
    known = dictionary(tables.sparkSession) if known is None else known
    several = known.where("label = 'untranslatable' AND contains(term, ' ')").select("term")
    cells = E.with_found(_text_cells(tables.where(F.size("data") > 1)), several, "cell")
    # each word of a cell with its number, and the cell's term once
    words = F.transform(T.words(F.col("cell")), lambda w: F.struct(w.alias("word"), F.col("found.hit").alias("hit")))
    rows = cells.select(F.explode(words).alias("x")).where(F.length("x.word") > 2).groupBy("x.word", "x.hit").agg(F.count("*").alias("n"))  # before the join, so that only distinct words meet the dictionary
    both = rows.join(known.select(F.col("term").alias("word"), F.col("label").alias("own")), "word", "left")
    label = F.when(F.col("own").isin("translatable", "untranslatable"), F.col("own")).when(F.col("hit").isNotNull(), "untranslatable").when(~F.col("word").isin(T.TRACKING_STOP_WORDS), "unknown")
    term = F.when(F.col("own").isin("translatable", "untranslatable"), F.col("word")).otherwise(F.coalesce("hit", "word"))
    return both.select(label.alias("label"), term.alias("term"), "n").where("label IS NOT NULL").groupBy("label", "term").agg(F.sum("n").alias("occurrences"))


def top_per_category(scores: DataFrame, n: int = 100) -> DataFrame:
    """The n best of each category, by score and then name; Spark prunes ranks beyond n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "table_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def existing(ranked: DataFrame, tables: DataFrame) -> DataFrame:
    """Ranked tables that are there, with their sizes; missing ones are dropped after the cut and not replaced."""
    sizes = tables.select("table_id", C.dimension(F.col("data")).alias("num_rows"), C.dimension(F.col("columns")).alias("num_columns"))
    return ranked.join(sizes, "table_id").withColumn("total_cells", F.col("num_rows") * F.col("num_columns"))


def upper_median(column: str) -> Column:
    """The middle of the sorted values, or the upper of two: counted from above, the first that half of them reach."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def selection_report(selected: DataFrame) -> DataFrame:
    """By category. The tables have been cut to the best of each, so few names come together."""
    return selected.groupBy("category").agg(
        F.count("*").alias("tables"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("score"), 4).alias("avg_score"), upper_median("score").alias("median_score"),
        F.round(F.avg("num_rows"), 4).alias("avg_rows"), F.round(F.avg("num_columns"), 4).alias("avg_columns"), F.round(F.avg("total_cells"), 4).alias("avg_cells"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "table_id"))), 1, 10), lambda x: x["table_id"]), ",").alias("top_10"),
    )


def selection_buckets(selected: DataFrame) -> DataFrame:
    exact = [F.count_if(F.col("score") == i).alias(f"score_{i}") for i in (10, 9, 8, 7, 6)]
    return selected.groupBy("category").agg(*exact, F.count_if(F.col("score") <= 5).alias("score_5_or_less"))


def csv_summary(selected: DataFrame) -> DataFrame:
    """The printed summary of tables selected (category, score, num_rows, num_columns, has_metadata), by category: means of two decimals, sizes of none, as text."""
    exact = [F.count_if(F.col("score") == i).alias(f"score_{i}") for i in (10, 9, 8)]
    means = [F.avg(c).alias(a) for a, c in (("avg_score", "score"), ("avg_rows", "num_rows"), ("avg_columns", "num_columns"))]
    sums = selected.groupBy("category").agg(F.count("*").alias("tables"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), *means, *exact, F.count_if("has_metadata").alias("metadata_files"))
    return sums.withColumns({c: T.printed(F.col(c), 2 * (c == "avg_score")) for c in ("avg_score", "avg_rows", "avg_columns")})
