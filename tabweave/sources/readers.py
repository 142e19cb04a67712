"""Readers: table JSON, JSON lines, image catalogues, scores, statistics, raw files; searches are in `search`."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.cells import typed


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)


def tables(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.json") -> DataFrame:
    """(table_id, columns, data, kinds, malformed) of JSON files, one table each. A file that can't be read has nulls and is marked.

    Cells are texts: strings as they are, numbers as Spark writes them, a bare NaN as NaN; kinds tells which were numbers (or booleans).
    """
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("columnNameOfCorruptRecord", "_bad")
    rows = reader.schema("columns ARRAY<STRING>, data ARRAY<ARRAY<VARIANT>>, _bad STRING").json(path)
    data, kinds = typed(F.col("data"))
    return rows.select(_stem().alias("table_id"), "columns", data.alias("data"), kinds.alias("kinds"), F.col("_bad").isNotNull().alias("malformed"))


def first_tables(rows: DataFrame, most: int, order: str = "table_id") -> DataFrame:
    """At most so many tables, the first by name; the sort keeps only so many rows."""
    return rows.orderBy(order).limit(most)


def wiki_tables(spark: SparkSession, path: str) -> DataFrame:
    """(page_title, columns, data) of a JSON dump in which each line has a `table` with header, rows and page_title."""
    rows = spark.read.schema("table STRUCT<header: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>, page_title: STRING>").json(path)
    return rows.select("table.page_title", F.col("table.header").alias("columns"), F.col("table.rows").alias("data"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema.METADATA).json(path).withColumn("stem", _stem())


def quality(spark: SparkSession, path: str) -> DataFrame:
    """Translation-quality rows below a folder."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema.QUALITY).json(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line, value, parsed): lines that aren't blank, with their JSON; value is null where it can't be read.

    line_no grows along each file and from file to file, without being dense.
    """
    rows = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    return rows.select("line_no", F.col("value").alias("line"), parsed.alias("value"), parsed.isNotNull().alias("parsed"))


def field(value: Column, name: str) -> Column:
    """A field of a JSON value as text: strings as they are, the rest as JSON."""
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.to_json(F.try_variant_get(value, f"$.{name}", "variant")))


def dataset(lines: DataFrame) -> DataFrame:
    """Lines of a question set that can be read."""
    v = F.col("value")
    return lines.where("parsed").select("line_no", field(v, "question_id").alias("question_id"), field(v, "table_id").alias("table_id"), F.coalesce(field(v, "language"), F.lit("en")).alias("language"), field(v, "question").alias("question"), field(v, "answer").alias("golden_answer"), field(v, "reasoning_category").alias("reasoning_category"))


def responses(lines: DataFrame) -> DataFrame:
    """Lines of a response file, those that can't be read too, which are marked."""
    v = F.col("value")
    return lines.select("line_no", "parsed", *(field(v, n).alias(n) for n in ("question_id", "image_filename", "model_response", "model_name")))


def completed(lines: DataFrame) -> DataFrame:
    """Distinct (question_id, image_filename) of a result file, both there."""
    return responses(lines).where("coalesce(question_id, '') <> '' AND coalesce(image_filename, '') <> ''").select("question_id", "image_filename").distinct()


def image_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(table_id, image_type, image_filename) of {root}/{table_id}/{image_type}/*.jpg; the images aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root).select("path")
    part = F.split("path", "/")
    return files.select(F.element_at(part, -3).alias("table_id"), F.element_at(part, -2).alias("image_type"), F.element_at(part, -1).alias("image_filename"))


def scores(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """(category, table_id, score) of *_table_scores.json files; of entries that share category and table the last counts."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "*_table_scores.json").schema(schema.SCORES).json(path)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_table_scores\.json$", 1).alias("category"), F.posexplode("tables").alias("at", "t")).groupBy("category", F.col("t.file").alias("table_id")).agg(F.max_by("t.score", "at").alias("score"))
    return rows.where(F.lower("category").isin([c.lower() for c in categories])) if categories else rows


def medians(spark: SparkSession, path: str) -> DataFrame:
    """(source, median) of a statistics file with a median_characters_per_file for each source."""
    rows = spark.read.option("multiLine", True).schema("sources MAP<STRING, STRUCT<median_characters_per_file: DOUBLE>>").json(path)
    return rows.select(F.explode("sources").alias("source", "x")).select("source", F.col("x.median_characters_per_file").alias("median"))


def char_stats(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, chars) of a statistics file."""
    rows = spark.read.option("multiLine", True).schema("individual_files MAP<STRING, BIGINT>").json(path)
    return rows.select(F.explode("individual_files").alias("file_name", "chars"))


def small_files(spark: SparkSession, path: str, pattern: str = "*.csv", most: int = 10_000_000) -> DataFrame:
    """(path, content): files up to a size as text: UTF-8, else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).where(F.col("length") <= most)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("content"))


def financial_tables(rows: DataFrame, table: str = "table") -> DataFrame:
    """Rows with a nested table of at least two rows: the first is the header."""
    return rows.where(F.size(table) >= 2).withColumns({"columns": F.element_at(table, 1), "data": F.expr(f"slice({table}, 2, size({table}) - 1)")})


def search_hits(items: DataFrame) -> DataFrame:
    """Hits of a code search that end in .csv and name owner and repository, each address once."""
    ok = items.where(F.col("path").endswith(".csv") & F.col("owner").isNotNull() & F.col("repo").isNotNull())
    url = F.format_string("https://raw.%s.invalid/%s/%s/%s", F.col("host"), "owner", "repo", "path")
    return ok.withColumn("download_url", url).dropDuplicates(["download_url"])

