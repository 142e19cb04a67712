"""Character statistics and the median filter. Tables: table_id, source, chars (letters)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources, in the order in which names are tested.
SOURCES = ["arxiv", "wikisql", "finqa"]


def source_of(file_name: Column) -> Column:
    """The first source whose name the file's name holds, else other."""
    low = F.lower(file_name)
    return F.coalesce(*(F.when(low.contains(s), s) for s in SOURCES), F.lit("other"))


def category_of(file_name: Column, categories: list[str]) -> Column:
    """The first category that the name begins with; null if none."""
    return F.coalesce(*(F.when(F.lower(file_name).startswith(c), c) for c in categories), F.lit(None).cast("string"))


def hash_of(file_name: Column) -> Column:
    """What follows the first underscore, without .json; else the whole stem."""
    stem = F.regexp_replace(file_name, r"\.json$", "")
    rest = F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)
    return F.when(rest != "", rest).otherwise(stem)


def _summary(chars: Column) -> list[Column]:
    return [
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("total_english_characters"),
        F.round(F.avg(chars), 2).alias("average_characters_per_file"),
        F.round(F.percentile(chars, 0.5), 2).alias("median_characters_per_file"),
        F.mode(chars, True).alias("mode_characters_per_file"),
    ]


def char_stats_by_source(tables: DataFrame) -> DataFrame:
    """Count, sum, mean, median, mode (the least of the most frequent), least and greatest by source."""
    return tables.groupBy("source").agg(*_summary(F.col("chars")), F.min("chars").alias("min_characters"), F.max("chars").alias("max_characters"))


def char_stats_overall(tables: DataFrame) -> DataFrame:
    return tables.agg(*_summary(F.col("chars")))


def with_threshold(tables: DataFrame, overall: bool = False) -> DataFrame:
    """Adds the median of the table's source (or of all) as threshold, 0 where there is none, and the decision."""
    if overall:
        medians = tables.agg(F.percentile("chars", 0.5).alias("median"))
        out = tables.join(F.broadcast(medians))  # one row
    else:
        medians = tables.groupBy("source").agg(F.percentile("chars", 0.5).alias("median"))
        out = tables.join(medians, "source", "left")
    out = out.withColumn("threshold", F.coalesce("median", F.lit(0.0))).drop("median")
    return out.withColumn("decision", F.when(F.col("chars") >= F.col("threshold"), "kept").otherwise("excluded"))


def in_order(decided: DataFrame, decision: str) -> DataFrame:
    """The tables with a decision: those kept from the most characters down, those excluded from the fewest up; ties by name."""
    return decided.where(F.col("decision") == decision).orderBy(F.desc("chars") if decision == "kept" else F.asc("chars"), "table_id")


def filter_summary(decided: DataFrame) -> DataFrame:
    """By source, and for `other` even where it has none: kept, excluded and the share kept in per cent."""
    counts = decided.groupBy("source").agg(F.count_if(F.col("decision") == "kept").alias("kept"), F.count_if(F.col("decision") == "excluded").alias("excluded"))
    none = decided.sparkSession.range(1).select(F.lit("other").alias("source"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("excluded"))
    both = counts.unionByName(none).groupBy("source").agg(F.sum("kept").alias("kept"), F.sum("excluded").alias("excluded"))
    total = F.col("kept") + F.col("excluded")
    return both.withColumn("kept_percent", F.when(total > 0, F.round(F.col("kept") * 100.0 / total, 2)).otherwise(0.0))


def keyword_counts(files: DataFrame, keywords: list[str], name: str = "file_name") -> DataFrame:
    """How many names hold each keyword; a name can count more than once."""
    each = F.explode(F.array(*(F.lit(k) for k in keywords)))
    return files.select(F.lower(name).alias("n"), each.alias("keyword")).groupBy("keyword").agg(F.count_if(F.col("n").contains(F.col("keyword"))).alias("files"))
