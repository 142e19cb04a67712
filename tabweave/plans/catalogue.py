"""Queries by name, and the DuckDB SQL they are held against. Where SQL can't express a query it has none."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import metrics as M
from ..functions import text as T
from ..operators import collect, evaluate, print_tables, render, scoring, stats, translate, worklists
from ..schema import LANGUAGES, QA_LANGUAGES
from ..sources import stores
from . import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Statistics and filters ------------------------------------------------------------------------------------------


def _chars(spark: SparkSession, sf: str) -> DataFrame:
    return A.tables(spark, sf).select("table_id", "source", "file_name", C.table_letters(F.col("data")).alias("chars"))


@query("char_count_per_table", _with(A.TABLES_SQL) + "SELECT table_id, source, chars FROM tables")
def char_count_per_table(spark, sf):
    return _chars(spark, sf).drop("file_name")


_STATS = """count(*) AS total_files, sum(chars)::BIGINT AS total_english_characters, round(avg(chars), 2) AS average_characters_per_file,
  round(median(chars), 2)::DOUBLE AS median_characters_per_file"""


@query(
    "char_stats_by_source",
    _with(A.TABLES_SQL, "modes AS (SELECT source, chars FROM tables GROUP BY source, chars QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, chars) = 1)")
    + f"SELECT t.source, {_STATS.replace('chars', 't.chars').replace('average_characters', 'average_characters')}, any_value(m.chars) AS mode_characters_per_file, min(t.chars) AS min_characters, max(t.chars) AS max_characters FROM tables t JOIN modes m ON t.source = m.source GROUP BY t.source",
)
def char_stats_by_source(spark, sf):
    return stats.char_stats_by_source(_chars(spark, sf))


@query("char_stats_overall", _with(A.TABLES_SQL) + f"SELECT {_STATS}, (SELECT chars FROM tables GROUP BY chars ORDER BY count(*) DESC, chars LIMIT 1) AS mode_characters_per_file FROM tables")
def char_stats_overall(spark, sf):
    return stats.char_stats_overall(_chars(spark, sf))


_SOURCE = "CASE WHEN contains(file_name, 'arxiv') THEN 'arxiv' WHEN contains(file_name, 'wikisql') THEN 'wikisql' WHEN contains(file_name, 'finqa') THEN 'finqa' ELSE 'other' END"


@query("source_classify_counts", _with(A.TABLES_SQL) + f"SELECT {_SOURCE} AS file_source, count(*) AS files, min(regexp_replace(regexp_replace(file_name, '\\.json$', ''), '^[^_]*_', '')) AS first_hash FROM tables GROUP BY 1")
def source_classify_counts(spark, sf):
    rows = A.tables(spark, sf).select(stats.source_of(F.col("file_name")).alias("file_source"), stats.hash_of(F.col("file_name")).alias("hash"))
    return rows.groupBy("file_source").agg(F.count("*").alias("files"), F.min("hash").alias("first_hash"))


@query("keyword_counts", _with(A.TABLES_SQL) + "SELECT k AS keyword, count(*) FILTER (contains(file_name, k)) AS files FROM tables, (VALUES ('arxiv'), ('finqa'), ('github'), ('csv')) AS v(k) GROUP BY k")
def keyword_counts(spark, sf):
    return stats.keyword_counts(A.tables(spark, sf), ["arxiv", "finqa", "github", "csv"])


_DECIDED = "decided AS (SELECT table_id, source, chars, threshold, CASE WHEN chars >= threshold THEN 'kept' ELSE 'excluded' END AS decision FROM tables JOIN (SELECT source, median(chars)::DOUBLE AS threshold FROM tables GROUP BY source) USING (source))"


def _decided(spark, sf):
    return stats.with_threshold(_chars(spark, sf)).select("table_id", "source", "chars", "threshold", "decision")


for _kind in ("kept", "excluded"):
    query(f"median_filter_{_kind}", _with(A.TABLES_SQL, _DECIDED) + f"SELECT table_id, source, chars, threshold FROM decided WHERE decision = '{_kind}'")(lambda spark, sf, kind=_kind: _decided(spark, sf).where(F.col("decision") == kind).drop("decision"))


@query(
    "median_filter_summary",
    _with(A.TABLES_SQL, _DECIDED)
    + "SELECT source, kept, excluded, CASE WHEN kept + excluded > 0 THEN round(kept * 100.0 / (kept + excluded), 2) ELSE 0 END::DOUBLE AS kept_percent FROM (SELECT source, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'excluded') AS excluded FROM decided GROUP BY source UNION ALL SELECT 'other', 0, 0)",
)
def median_filter_summary(spark, sf):
    return stats.filter_summary(_decided(spark, sf))


@query("global_threshold_filter", _with(A.TABLES_SQL) + "SELECT table_id, chars FROM tables WHERE chars >= (SELECT median(chars) FROM tables)")
def global_threshold_filter(spark, sf):
    return stats.with_threshold(_chars(spark, sf), overall=True).where("decision = 'kept'").select("table_id", "chars")


# Cells are blanked by their hash, some as empty texts, some as NaN and some as nulls, so that some tables miss cells and others don't.
_HOLES = "holes AS (SELECT table_id, list_transform(flatten(data), lambda c: CASE ('0x' || md5(c)[1:2])::INT WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL WHEN 3 THEN '  ' ELSE c END) AS cells FROM tables)"
_BLANK = "len(list_filter(cells, lambda c: c IS NULL OR trim(c, ' ') = '' OR c = 'NaN')) > 0"


def _holes(spark, sf):
    by = lambda c: F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("int")
    blank = lambda c: F.when(by(c) == 0, "").when(by(c) == 1, "NaN").when(by(c) == 2, None).when(by(c) == 3, "  ").otherwise(c)
    return A.tables(spark, sf).withColumn("data", F.transform("data", lambda r: F.transform(r, blank)))


@query("missing_cell_tables", _with(A.TABLES_SQL, _HOLES) + f"SELECT table_id FROM holes WHERE {_BLANK}")
def missing_cell_tables(spark, sf):
    return collect.missing_tables(_holes(spark, sf), blank=True).select("table_id")


@query("complete_tables", _with(A.TABLES_SQL, _HOLES) + f"SELECT table_id FROM holes WHERE NOT {_BLANK}")
def complete_tables(spark, sf):
    return collect.complete_tables(_holes(spark, sf), blank=True).select("table_id")


@query("missing_values_tables", _with(A.TABLES_SQL, _HOLES) + "SELECT table_id FROM holes WHERE len(list_filter(cells, lambda c: c IS NULL OR c = 'NaN')) > 0")
def missing_values_tables(spark, sf):
    """Nulls and NaN alone; empty texts are values."""
    return collect.missing_tables(_holes(spark, sf)).select("table_id")


# Metadata --------------------------------------------------------------------------------------------------------


def _labels(spark, sf):
    return A.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("table_id"), "quality")


@query("metadata_left_join", "SELECT d.doc_id::VARCHAR AS table_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS has_metadata FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_left_join(spark, sf):
    tables = A.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("table_id"))
    return collect.with_metadata(tables, _labels(spark, sf)).select("table_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "has_metadata")


@query("metadata_missing", "SELECT doc_id::VARCHAR AS table_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def metadata_missing(spark, sf):
    tables = A.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("table_id"))
    return tables.join(_labels(spark, sf), "table_id", "left_anti")


@query("metadata_contains_join", "WITH s AS (SELECT DISTINCT source AS hash FROM documents) SELECT a.hash, min(b.hash) AS stem FROM s a JOIN s b ON contains(b.hash, a.hash) GROUP BY a.hash")
def metadata_contains_join(spark, sf):
    names = A.read(spark, sf, "documents").select("source").distinct()
    return collect.metadata_by_hash(names.select(F.col("source").alias("hash")), names.select(F.col("source").alias("stem")))


# Translatability -------------------------------------------------------------------------------------------------


def _count_sql(c: str) -> str:
    quoted = lambda x: x.replace("'", "''")
    parts = [f"(length({c}) - length(replace({c}, '{quoted(p)}', '')))" for p in T.OPERATORS + T.SYMBOLS]
    parts += [f"(length({c}) - length(replace(lower({c}), '{p}', ''))) // {len(p)}" for p in T.MATH_FUNCTIONS]
    return f"(len(regexp_extract_all({c}, '\\d+\\.?\\d*')) + {' + '.join(parts)})"


_TERMS = "|".join(C.UNTRANSLATABLE)
_NUMERIC_SQL = "(regexp_matches(cell, '^\\p{Nd}+$') OR cell IN ('0', '1', '0.0', '1.0'))"
_PATH_SQL = f"(contains(cell, '/') OR contains(cell, chr(92)) OR regexp_matches(cell, '\\.({'|'.join(C.FILE_ENDINGS)})$'))"
_REASON = f"""CASE WHEN {_NUMERIC_SQL} THEN 'numeric_universal'
  WHEN {_PATH_SQL} THEN CASE WHEN {_count_sql('seg')} >= length(seg) * 0.3 THEN 'file_path_mostly_universal' ELSE 'file_path_with_content' END
  WHEN regexp_matches(lower(cell), '{_TERMS}') THEN 'untranslatable_label'
  WHEN {_count_sql('cell')} >= length(cell) * 0.5 THEN 'mostly_universal' ELSE 'translatable_text' END"""
_POINTS = "CASE reason WHEN 'file_path_mostly_universal' THEN 95 WHEN 'file_path_with_content' THEN 85 WHEN 'untranslatable_label' THEN 0 WHEN 'translatable_text' THEN 90 ELSE 100 END"
_CELLS = f"""rws AS (SELECT table_id, category, unnest(range(len(data))) AS row_idx, unnest(data) AS r, len(data) AS n_rows FROM tables),
cells AS (SELECT table_id, category, row_idx, n_rows, unnest(range(len(r))) AS col_idx, unnest(r) AS cell FROM rws),
scored AS (SELECT *, {_POINTS} AS points FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, list_extract(string_split(cell, '/'), -1) AS seg FROM cells)))"""
_ANALYSIS = """analysis AS (
  SELECT t.table_id, t.category, count(s.points) AS total_cells, count(*) FILTER (points >= 70) AS cells_maintaining_meaning, count(*) FILTER (points < 30) AS cells_losing_meaning,
    count(*) FILTER (points >= 30 AND points < 70) AS cells_partially_translatable, coalesce(round(sum(points)::DOUBLE / 100.0::DOUBLE / count(points), 2), 0)::DOUBLE AS average_translatability, count(*) FILTER (points = 0) AS untranslatable_count
  FROM tables t LEFT JOIN (SELECT * FROM scored WHERE n_rows > 1) s ON t.table_id = s.table_id GROUP BY t.table_id, t.category)"""
_SCORES = """scores AS (
  SELECT table_id, category, CASE WHEN total_cells = 0 THEN 1 ELSE greatest(1, least(10, round_even(0.7::DOUBLE * least(10::DOUBLE, cells_maintaining_meaning::DOUBLE / total_cells / 0.7::DOUBLE * 10) + average_translatability * 10 * 0.3::DOUBLE, 0)::INT)) END::INT AS score FROM analysis)"""
_UP_TO_SCORES = (A.TABLES_SQL, _CELLS, _ANALYSIS, _SCORES)


@query("cell_translatability", _with(A.TABLES_SQL, _CELLS) + "SELECT table_id, row_idx::INT AS row_idx, col_idx::INT AS col_idx, points / 100.0::DOUBLE AS score, reason FROM scored")
def cell_translatability(spark, sf):
    return scoring.cell_translatability(scoring.cells(A.tables(spark, sf))).select("table_id", "row_idx", "col_idx", "score", "reason")


@query(
    "typed_cells",
    "SELECT o_orderkey::VARCHAR AS table_id, (k - 1)::INT AS col_idx, ['number', 'text', 'number', NULL, 'number', 'other', 'text'][k] AS kind, [NULL, o_orderstatus, NULL, NULL, NULL, NULL, '1.50'][k] AS cell, CASE k WHEN 1 THEN o_totalprice WHEN 5 THEN o_custkey END::DOUBLE AS number, ['numeric_universal', 'translatable_text', 'numeric_universal', 'non_string_universal', 'numeric_universal', 'non_string_universal', 'translatable_text'][k] AS reason FROM orders, range(1, 8) AS r(k)",
)
def typed_cells(spark, sf):
    """Cells of JSON tables that are numbers, texts, booleans, null or nested; numbers are compared as such."""
    text = F.format_string('[[%s, "%s", true, null, %s, {"a": 1}, "1.50"]]', F.col("o_totalprice").cast("string"), "o_orderstatus", F.col("o_custkey").cast("string"))
    data, kinds = C.typed(F.from_json(text, "array<array<variant>>"))
    tables = A.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("table_id"), F.lit("x").alias("category"), F.array().cast("array<string>").alias("columns"), data.alias("data"), kinds.alias("kinds"))
    out = scoring.cell_translatability(scoring.cells(tables))
    return out.select("table_id", "col_idx", "kind", F.when(F.col("kind") == "text", F.col("cell")).alias("cell"), F.when(F.col("kind") == "number", F.col("cell").try_cast("double")).alias("number"), "reason")


@query(
    "typed_table_score",
    """SELECT o_orderkey::VARCHAR AS table_id, (CASE WHEN n > 1 THEN 4 * n ELSE 0 END)::BIGINT AS total_cells, (CASE WHEN n > 1 THEN (4 - gpt) * n ELSE 0 END)::BIGINT AS cells_maintaining_meaning, (CASE WHEN n > 1 THEN gpt * n ELSE 0 END)::BIGINT AS cells_losing_meaning,
  CASE WHEN n > 1 THEN round(((100 + CASE WHEN gpt = 1 THEN 0 ELSE 90 END + 100 + CASE WHEN nested THEN 100 ELSE 90 END) * n) / 100.0::DOUBLE / (4 * n), 2) ELSE 0 END::DOUBLE AS average_translatability
  FROM (SELECT *, 1 + o_custkey % 4 AS n, (o_orderkey % 5 = 0)::INT AS gpt, o_orderkey % 3 = 0 AS nested FROM orders)""",
)
def typed_table_score(spark, sf):
    """One to four equal rows of a number, a text (some untranslatable), a truth, and a nested value or a text that looks like a number but for its sign."""
    text = F.when(F.col("o_orderkey") % 5 == 0, "a GPT model").otherwise(F.col("o_orderstatus"))
    last = F.when(F.col("o_orderkey") % 3 == 0, '{"a": [1]}').otherwise('"minus 1.5 by far"')
    row = F.format_string('[%s, "%s", true, %s]', F.col("o_totalprice").cast("string"), text, last)
    data, kinds = C.typed(F.from_json(F.concat(F.lit("["), F.array_join(F.array_repeat(row, (1 + F.col("o_custkey") % 4).cast("int")), ","), F.lit("]")), "array<array<variant>>"))
    tables = A.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("table_id"), F.lit("x").alias("category"), data.alias("data"), kinds.alias("kinds"))
    return scoring.table_translatability(tables).select("table_id", "total_cells", "cells_maintaining_meaning", "cells_losing_meaning", "average_translatability")


def _analysis(spark, sf):
    return scoring.table_translatability(A.tables(spark, sf))


@query("table_translatability", _with(*_UP_TO_SCORES[:3]) + "SELECT * FROM analysis")
def table_translatability(spark, sf):
    return _analysis(spark, sf)


def _scores(spark, sf):
    return scoring.table_scores(_analysis(spark, sf))


@query("table_score", _with(*_UP_TO_SCORES) + "SELECT * FROM scores")
def table_score(spark, sf):
    return _scores(spark, sf)


@query("score_distribution", _with(*_UP_TO_SCORES) + "SELECT category, s::INT AS score, count(*) FILTER (score = s) AS tables FROM scores, range(1, 11) AS r(s) GROUP BY category, s")
def score_distribution(spark, sf):
    return scoring.score_distribution(_scores(spark, sf))


@query("category_score_summary", _with(*_UP_TO_SCORES) + "SELECT category, count(*) AS total_tables, round(avg(score), 2) AS average_score FROM scores GROUP BY category")
def category_score_summary(spark, sf):
    return scoring.category_summary(_scores(spark, sf))


_WORDS = f"words AS (SELECT cell, unnest(list_filter(regexp_extract_all(lower(cell), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z_]+$'))) AS word FROM cells WHERE NOT ({_NUMERIC_SQL} OR {_PATH_SQL}))"
_CELLS_ONLY = ", ".join(_CELLS.split(",\nscored")[0].split(",\n"))


@query("distinct_terms", _with(A.TABLES_SQL, _CELLS_ONLY, _WORDS) + f"SELECT DISTINCT word AS term FROM words WHERE length(word) > 2 AND word NOT IN ({_in(T.STOP_WORDS)})")
def distinct_terms(spark, sf):
    return scoring.distinct_terms(A.tables(spark, sf))


# RE2's boundaries are those of ASCII words: letters beyond ASCII become underscores, which are of a word and of no phrase.
_PHRASES = "phrases AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(cell), '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g'), '(\\b[a-z]+\\s+[a-z]+(?:\\s+[a-z]+)?\\b)')) AS term FROM cells WHERE NOT (" + f"{_NUMERIC_SQL} OR {_PATH_SQL}))"


@query("distinct_phrases", _with(A.TABLES_SQL, _CELLS_ONLY, _WORDS, _PHRASES) + f"SELECT DISTINCT term FROM (SELECT word AS term FROM words UNION ALL SELECT term FROM phrases) WHERE length(term) > 2 AND term NOT IN ({_in(T.STOP_WORDS)})")
def distinct_phrases(spark, sf):
    """Words and phrases."""
    return scoring.distinct_terms(A.tables(spark, sf), with_phrases=True)


@query("unknown_terms", _with(A.TABLES_SQL, _CELLS_ONLY, _WORDS) + f"SELECT DISTINCT word AS term FROM words WHERE length(word) > 2 AND word NOT IN ({_in(T.STOP_WORDS)}) AND word NOT IN ({_in(C.TRANSLATABLE + C.UNTRANSLATABLE)})")
def unknown_terms(spark, sf):
    known = spark.createDataFrame([(t, "known") for t in C.TRANSLATABLE + C.UNTRANSLATABLE], "term string, label string")
    return scoring.unknown_terms(scoring.distinct_terms(A.tables(spark, sf)), known)


_TRACKED = "tracked AS (SELECT w.* FROM (SELECT cell, unnest(list_filter(regexp_extract_all(lower(cell), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z_]+$') AND length(w) > 2)) AS word FROM cells WHERE n_rows > 1 AND NOT (" + f"{_NUMERIC_SQL} OR {_PATH_SQL})) w)"
_SEVERAL = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(cell), '{t}') THEN '{t}' END" for t in sorted(C.UNTRANSLATABLE) if " " in t) + ")"


@query(
    "term_frequency",
    _with(A.TABLES_SQL, _CELLS_ONLY, _TRACKED)
    + f"""SELECT label, term, count(*) AS occurrences FROM (
  SELECT CASE WHEN word IN ({_in(C.TRANSLATABLE)}) THEN 'translatable' WHEN word IN ({_in(C.UNTRANSLATABLE)}) OR hit IS NOT NULL THEN 'untranslatable' WHEN word NOT IN ({_in(T.TRACKING_STOP_WORDS)}) THEN 'unknown' END AS label,
    CASE WHEN word IN ({_in(C.TRANSLATABLE + C.UNTRANSLATABLE)}) THEN word ELSE coalesce(hit, word) END AS term FROM (SELECT word, {_SEVERAL} AS hit FROM tracked)) WHERE label IS NOT NULL GROUP BY label, term""",
)
def term_frequency(spark, sf):
    return scoring.term_frequency(A.tables(spark, sf))


_LABELLED = f"labelled AS (SELECT DISTINCT word AS term FROM words WHERE length(word) > 5 AND word NOT IN ({_in(T.STOP_WORDS)}) AND word NOT IN ({_in(C.TRANSLATABLE + C.UNTRANSLATABLE)}) AND ('0x' || md5(word)[1:4])::INT % 40 = 0)"


def _learnt(spark, sf):
    """The dictionary, and words of six letters or more that it lacks; of these a fortieth, by md5, are labelled as a model would."""
    known = scoring.dictionary(spark)
    new = scoring.unknown_terms(scoring.distinct_terms(A.tables(spark, sf)), known).where(F.length("term") > 5)
    labelled = new.withColumn("label", F.when(F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int") % 40 == 0, "untranslatable").otherwise("translatable"))
    return scoring.learn_terms(known, labelled)


@query(
    "learnt_term_scores",
    _with(A.TABLES_SQL, _CELLS, _WORDS, _LABELLED)
    + """SELECT table_id, count(*) AS total_cells, count(*) FILTER (reason = 'untranslatable_label') AS untranslatable_count FROM (
  SELECT table_id, CASE WHEN reason IN ('mostly_universal', 'translatable_text') AND EXISTS (SELECT 1 FROM labelled WHERE contains(lower(scored.cell), term)) THEN 'untranslatable_label' ELSE reason END AS reason FROM scored WHERE n_rows > 1) GROUP BY table_id""",
)
def learnt_term_scores(spark, sf):
    """Tables scored with the terms that were learnt from them."""
    found = scoring.table_translatability(A.tables(spark, sf), _learnt(spark, sf))
    return found.where("total_cells > 0").select("table_id", "total_cells", "untranslatable_count")


# Selection -------------------------------------------------------------------------------------------------------

TOP = 10
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, table_id)::INT AS rank FROM scores QUALIFY rank <= {TOP})"
_SELECTED = "selected AS (SELECT r.*, len(t.data)::BIGINT AS num_rows, len(t.data[1])::BIGINT AS num_columns, (len(t.data) * len(t.data[1]))::BIGINT AS total_cells FROM ranked r JOIN tables t ON r.table_id = t.table_id WHERE t.doc_id IN (SELECT doc_id FROM labels))"


def _selected(spark, sf):
    """Tables without a label are missing after the cut."""
    there = A.tables(spark, sf).join(_labels(spark, sf), "table_id", "left_semi")
    return scoring.existing(scoring.top_per_category(_scores(spark, sf), TOP), there)


@query("topn_per_category", _with(*_UP_TO_SCORES, _RANKED) + "SELECT * FROM ranked")
def topn_per_category(spark, sf):
    return scoring.top_per_category(_scores(spark, sf), TOP)


@query("selection_existing", _with(*_UP_TO_SCORES, _RANKED, _SELECTED) + "SELECT * FROM selected")
def selection_existing(spark, sf):
    return _selected(spark, sf)


@query(
    "selection_report",
    _with(*_UP_TO_SCORES, _RANKED, _SELECTED)
    + "SELECT category, count(*) AS tables, min(score) AS min_score, max(score) AS max_score, round(avg(score), 4) AS avg_score, list_sort(list(score))[len(list(score)) // 2 + 1] AS median_score, round(avg(num_rows), 4) AS avg_rows, round(avg(num_columns), 4) AS avg_columns, round(avg(total_cells), 4) AS avg_cells, array_to_string(list(table_id ORDER BY rank)[1:10], ',') AS top_10 FROM selected GROUP BY category",
)
def selection_report(spark, sf):
    return scoring.selection_report(_selected(spark, sf))


@query("selection_buckets", _with(*_UP_TO_SCORES, _RANKED, _SELECTED) + "SELECT category, " + ", ".join(f"count(*) FILTER (score = {i}) AS score_{i}" for i in (10, 9, 8, 7, 6)) + ", count(*) FILTER (score <= 5) AS score_5_or_less FROM selected GROUP BY category")
def selection_buckets(spark, sf):
    return scoring.selection_buckets(_selected(spark, sf))


@query(
    "selection_csv",
    _with(*_UP_TO_SCORES, _RANKED, _SELECTED)
    + "SELECT category, count(*) AS tables, min(score) AS min_score, max(score) AS max_score, printf('%.2f', avg(score)) AS avg_score, printf('%.0f', avg(num_rows)) AS avg_rows, printf('%.0f', avg(num_columns)) AS avg_columns, "
    + ", ".join(f"count(*) FILTER (score = {i}) AS score_{i}" for i in (10, 9, 8))
    + ", count(*) FILTER (table_id IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)) AS metadata_files FROM selected GROUP BY category",
)
def selection_csv(spark, sf):
    """Tables whose label is 1 have metadata."""
    return scoring.csv_summary(collect.with_metadata(_selected(spark, sf), _labels(spark, sf).where("quality = 1").select("table_id")))


# Evaluation ------------------------------------------------------------------------------------------------------


def _languages_sql(languages) -> str:
    return "|".join(sorted(languages, key=lambda x: (-len(x), x)))


@query(
    "image_language_extract",
    f"WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '_clean.jpg' WHEN 1 THEN 'id_casual_noise2.jpg' WHEN 2 THEN lang || '_art_clean.jpg' ELSE 'x/' || lang || '_noise1.v.jpg' END AS n FROM documents), g AS (SELECT doc_id, regexp_extract(regexp_replace(regexp_extract(n, '([^/]*)$', 1), '\\.[^.]*$', ''), '^({_languages_sql(QA_LANGUAGES)})_(clean|noise[1-3]?)$', 1) AS l FROM f) SELECT doc_id, CASE WHEN l <> '' THEN l ELSE 'unknown' END AS language FROM g",
)
def image_language_extract(spark, sf):
    docs = A.read(spark, sf, "documents")
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat("lang", F.lit("_clean.jpg"))).when(k == 1, "id_casual_noise2.jpg").when(k == 2, F.concat("lang", F.lit("_art_clean.jpg"))).otherwise(F.concat(F.lit("x/"), "lang", F.lit("_noise1.v.jpg")))
    return docs.select("doc_id", evaluate.image_language(name).alias("language"))


_GOLD = "gold AS (SELECT question_id, language, golden_answer FROM dataset QUALIFY row_number() OVER (PARTITION BY question_id, language ORDER BY line_no DESC) = 1)"
_TAGGED = """tagged AS (SELECT r.*, g.golden_answer, CASE WHEN NOT parsed THEN 'parse_error' WHEN g.question_id IS NULL THEN 'no_match'
  WHEN contains(model_response, 'CUDA out of memory') OR contains(model_response, 'Table too large') THEN 'skipped' ELSE 'processed' END AS outcome
  FROM responses r LEFT JOIN gold g ON r.question_id = g.question_id AND r.language = g.language)"""
_UP_TO_TAGGED = (A.DATASET_SQL, _GOLD, A.RESPONSES_SQL, _TAGGED)


def _tagged(spark, sf):
    return evaluate.tag(A.responses(spark, sf), A.dataset(spark, sf))


@query("dataset_last_wins", _with(A.DATASET_SQL, _GOLD) + "SELECT * FROM gold")
def dataset_last_wins(spark, sf):
    return evaluate.last_wins(A.dataset(spark, sf).drop("table_id"), ["question_id", "language"], "line_no").drop("line_no")


@query("eval_join_outcomes", _with(*_UP_TO_TAGGED) + "SELECT response_id, language, outcome FROM tagged")
def eval_join_outcomes(spark, sf):
    return _tagged(spark, sf).select("response_id", "language", "outcome")


@query(
    "eval_overall_counters",
    _with(*_UP_TO_TAGGED)
    + "SELECT count(*) AS total_responses, "
    + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in evaluate.OUTCOMES)
    + ", count(*) FILTER (outcome = 'skipped' AND contains(model_response, 'CUDA out of memory')) AS cuda_errors, count(*) FILTER (outcome = 'skipped' AND contains(model_response, 'Table too large')) AS table_errors FROM tagged",
)
def eval_overall_counters(spark, sf):
    return evaluate.counters(_tagged(spark, sf))


_TOKENS = "toks AS (SELECT id, list_filter(regexp_split_to_array(prediction, '\\s+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(truth, '\\s+'), lambda x: x <> '') AS t, prediction, truth FROM pairs)"
_OVERLAP = """overlap AS (SELECT id, sum(least(a, b)) AS both FROM (SELECT id, w, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS b
  FROM (SELECT id, unnest(p) AS w, 1 AS s FROM toks UNION ALL SELECT id, unnest(t), 2 FROM toks) GROUP BY id, w) GROUP BY id)"""


@query(
    "eval_exact_match_f1",
    _with(A.PAIRS_SQL, _TOKENS, _OVERLAP)
    + "SELECT k.id, (prediction = truth)::INT AS exact_match, CASE WHEN len(p) = 0 OR len(t) = 0 THEN (len(p) = len(t))::INT::DOUBLE ELSE coalesce(o.both, 0)::DOUBLE * 2 / (len(p) + len(t)) END AS f1_score FROM toks k LEFT JOIN overlap o ON k.id = o.id",
)
def eval_exact_match_f1(spark, sf):
    return evaluate.token_overlap(A.pairs(spark, sf).select("id", "prediction", "truth"))


_GRAMS = """grams AS (SELECT id, n, s, list_reduce(w[i:i + n - 1], lambda x, y: x || ' ' || y) AS g FROM (
  SELECT id, n, 1 AS s, p AS w, unnest(range(1, len(p) - n + 2)) AS i FROM toks, range(1, 5) AS r(n) WHERE len(p) >= n
  UNION ALL SELECT id, n, 2, t, unnest(range(1, len(t) - n + 2)) FROM toks, range(1, 5) AS r(n) WHERE len(t) >= n))"""
_MATCHED = """matched AS (SELECT id, n, sum(least(a, b)) AS m FROM (SELECT id, n, g, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS b FROM grams GROUP BY id, n, g) GROUP BY id, n)"""
_LOGS = """logs AS (SELECT k.id, len(p) AS l, len(t) AS r, """ + ", ".join(f"coalesce(max(CASE WHEN n = {k} THEN m END), 0) AS m{k}, ln(CASE WHEN coalesce(max(CASE WHEN n = {k} THEN m END), 0) = 0 THEN 0.1 ELSE max(CASE WHEN n = {k} THEN m END) END::DOUBLE / greatest(1, len(p) - {k - 1})) AS l{k}" for k in (1, 2, 3, 4)) + " FROM toks k LEFT JOIN matched m ON k.id = m.id GROUP BY k.id, p, t)"
_BLEU = """bleu AS (SELECT id, CASE WHEN l = 0 OR r = 0 OR m1 = 0 THEN 0 ELSE (CASE WHEN l > r THEN 1 ELSE exp(1 - r::DOUBLE / l) END) *
  CASE WHEN l <= 3 THEN exp(l1) WHEN l <= 7 THEN (exp(l1) + exp((l1 + l2) / 2)) / 2 ELSE (exp(l1) + exp((l1 + l2) / 2) + exp((l1 + l2 + l3 + l4) / 4)) / 3 END END::DOUBLE AS bleu FROM logs)"""


@query("eval_adaptive_bleu", _with(A.PAIRS_SQL, _TOKENS, _GRAMS, _MATCHED, _LOGS, _BLEU) + "SELECT id, round(bleu, 9) AS bleu_score FROM bleu")
def eval_adaptive_bleu(spark, sf):
    return A.pairs(spark, sf).select("id", F.round(M.adaptive_bleu("prediction", "truth"), 9).alias("bleu_score"))


@query(
    "eval_per_language",
    _with(A.PAIRS_SQL, _TOKENS, _OVERLAP, _GRAMS, _MATCHED, _LOGS, _BLEU)
    + f"SELECT {A.LANGS!r}[conv_id % 4 + 1] AS language, count(*) AS samples, round(avg((p.prediction = p.truth)::INT), 6) AS exact_match, round(avg(CASE WHEN len(k.p) = 0 OR len(k.t) = 0 THEN (len(k.p) = len(k.t))::INT::DOUBLE ELSE coalesce(o.both, 0)::DOUBLE * 2 / (len(k.p) + len(k.t)) END), 6) AS f1_score, round(avg(bleu), 6) AS bleu_score FROM pairs p JOIN toks k ON p.id = k.id JOIN bleu b ON p.id = b.id LEFT JOIN overlap o ON p.id = o.id GROUP BY 1",
)
def eval_per_language(spark, sf):
    rows = A.pairs(spark, sf).withColumn("language", F.element_at(F.array(*(F.lit(x) for x in A.LANGS)), (F.col("conv_id") % 4 + 1).cast("int")))
    a, b = "prediction", "truth"
    return evaluate.per_language(rows.withColumns({"exact_match": (F.col(a) == F.col(b)).cast("int"), "f1_score": M.token_f1(a, b), "bleu_score": M.adaptive_bleu(a, b)}))


def _line_sql(c: str) -> str:
    """The normalised line of a free text."""
    words = f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')"
    return f"lower(array_to_string(list_concat(list_transform(list_filter({words}, lambda w: regexp_matches(w, '^[0-9]+$')), lambda w: w::DOUBLE::BIGINT::VARCHAR), list_filter({words}, lambda w: regexp_matches(w, '^[a-zA-Z]+$'))), ' '))"


_LINES = f"pairs AS (SELECT response_id AS id, language, {_line_sql('model_response')} AS prediction, {_line_sql('golden_answer')} AS truth FROM tagged WHERE outcome = 'processed')"
_SCORED = """scored AS (SELECT p.id AS response_id, p.language, p.truth AS gold_str_normalized, p.prediction AS model_str_normalized, (p.prediction = p.truth)::INT AS exact_match,
  CASE WHEN len(k.p) = 0 OR len(k.t) = 0 THEN (len(k.p) = len(k.t))::INT::DOUBLE ELSE coalesce(o.both, 0)::DOUBLE * 2 / (len(k.p) + len(k.t)) END AS f1_score, bleu AS bleu_score
  FROM pairs p JOIN toks k ON p.id = k.id JOIN bleu b ON p.id = b.id LEFT JOIN overlap o ON p.id = o.id)"""
_UP_TO_SCORED = (*_UP_TO_TAGGED, _LINES, _TOKENS, _OVERLAP, _GRAMS, _MATCHED, _LOGS, _BLEU, _SCORED)


@query("eval_scored_responses", _with(*_UP_TO_SCORED) + "SELECT * EXCLUDE (f1_score, bleu_score), round(f1_score, 9) AS f1_score, round(bleu_score, 9) AS bleu_score FROM scored")
def eval_scored_responses(spark, sf):
    """Normalised answers (free texts here) and metrics of processed responses."""
    found = evaluate.score(_tagged(spark, sf))
    return found.select("response_id", "language", "gold_str_normalized", "model_str_normalized", "exact_match", *(F.round(c, 9).alias(c) for c in ("f1_score", "bleu_score")))


_CELL_TOKENS = "toks AS (SELECT table_id AS id, list_concat(data[1], flatten(data)) AS p, list_transform(list_concat(data[1], flatten(data)), lambda c: lower(c)) AS t FROM tables)"


@query(
    "table_bleu",
    _with(A.TABLES_SQL, _CELL_TOKENS, _GRAMS.replace("' '", "chr(1)"), _MATCHED, _LOGS)
    + "SELECT id AS table_id, round((CASE WHEN l = 0 OR r = 0 OR m1 = 0 THEN 0 ELSE (CASE WHEN l > r THEN 1 ELSE exp(1 - r::DOUBLE / l) END) * exp((l1 + l2 + l3 + l4) / 4) END)::DOUBLE, 9) AS bleu_score FROM logs",
)
def table_bleu(spark, sf):
    """Each table against itself in lower case: cells that are alike are matches."""
    t = A.tables(spark, sf).select("table_id", F.concat("columns", F.flatten("data")).alias("a"))
    return t.select("table_id", F.round(M.table_bleu("a", F.transform("a", lambda c: F.lower(c))), 9).alias("bleu_score"))


_QUESTIONS = "questions AS (SELECT question_id, table_id, language FROM dataset)"


def _questions(spark, sf):
    return A.dataset(spark, sf).select("question_id", "table_id", "language").distinct()


_INSTANCES = "inst AS (SELECT DISTINCT d.question_id, d.language, i.image_filename FROM dataset d JOIN images i ON d.table_id = i.table_id AND d.language = i.language WHERE i.image_type = '{}')"


@query("benchmark_instances", _with(A.DATASET_SQL, A.IMAGES_SQL, _INSTANCES.format("clean")) + "SELECT * FROM inst")
def benchmark_instances(spark, sf):
    return evaluate.instances(_questions(spark, sf), A.images(spark, sf)).select("question_id", "language", "image_filename")


@query("benchmark_prefix_instances", _with(A.DATASET_SQL, A.IMAGES_SQL) + "SELECT DISTINCT d.question_id, d.language, i.image_filename FROM dataset d JOIN images i ON d.table_id = i.table_id AND starts_with(i.image_filename, d.language || '_') WHERE i.image_type = 'clean'")
def benchmark_prefix_instances(spark, sf):
    return evaluate.instances(_questions(spark, sf), A.images(spark, sf), prefix=True).select("question_id", "language", "image_filename")


@query("noise_image_pick", _with(A.DATASET_SQL, A.IMAGES_SQL, _INSTANCES.format("noise")) + "SELECT * FROM inst QUALIFY row_number() OVER (PARTITION BY question_id, language ORDER BY md5(image_filename), image_filename) = 1")
def noise_image_pick(spark, sf):
    return evaluate.instances(_questions(spark, sf), A.images(spark, sf), image_type="noise").select("question_id", "language", "image_filename")


@query("benchmark_resume_anti", _with(A.DATASET_SQL, A.IMAGES_SQL, _INSTANCES.format("clean")) + "SELECT * FROM inst WHERE (question_id, language || '_clean.jpg') NOT IN (SELECT 'q_' || conv_id, " + repr(A.LANGS) + "[conv_id % 4 + 1] || '_clean.jpg' FROM conversations WHERE role = 'assistant' AND length(text) > 100)")
def benchmark_resume_anti(spark, sf):
    rows = evaluate.instances(_questions(spark, sf), A.images(spark, sf)).select("question_id", "language", "image_filename")
    said = A.read(spark, sf, "conversations").where("role = 'assistant' AND length(text) > 100")
    done = said.select(F.concat(F.lit("q_"), "conv_id").alias("question_id"), F.concat(A.language(F.col("conv_id")), F.lit("_clean.jpg")).alias("image_filename"))
    return evaluate.remaining(rows, done)


@query("language_filter", _with(A.DATASET_SQL, A.IMAGES_SQL, _INSTANCES.format("clean")) + "SELECT * FROM inst WHERE language = 'fr'")
def language_filter(spark, sf):
    return evaluate.instances(_questions(spark, sf), A.images(spark, sf), language="fr").select("question_id", "language", "image_filename")


# Work lists ------------------------------------------------------------------------------------------------------

FEW = LANGUAGES[:5]


def _done(spark, sf):
    docs = A.read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("table_id"))
    return worklists.by_language(docs, FEW).withColumn("i", F.array_position(F.array(*(F.lit(x) for x in FEW)), F.col("lang_code"))).where("(doc_id + i) % 3 <> 0 OR doc_id % 4 = 0")


_DONE = f"done AS (SELECT doc_id::VARCHAR AS table_id, {FEW!r}[i] AS lang_code FROM documents, range(1, {len(FEW) + 1}) AS r(i) WHERE (doc_id + i) % 3 <> 0 OR doc_id % 4 = 0)"


@query("translation_worklist", _with(_DONE) + f"SELECT doc_id::VARCHAR AS table_id, l AS lang_code FROM documents, unnest({FEW!r}) AS u(l) EXCEPT SELECT * FROM done")
def translation_worklist(spark, sf):
    return worklists.translation_worklist(A.tables(spark, sf), FEW, _done(spark, sf)).select("table_id", "lang_code")


@query("translation_complete_tables", _with(_DONE) + f"SELECT table_id, count(DISTINCT lang_code) AS languages FROM done GROUP BY table_id HAVING count(DISTINCT lang_code) = {len(FEW)}")
def translation_complete_tables(spark, sf):
    return worklists.complete_tables(_done(spark, sf), FEW)


@query("bleu_gate", "SELECT doc_id::VARCHAR AS table_id, lang AS lang_code, (n_chars % 101) / 100.0::DOUBLE AS bleu_score, 0.5::DOUBLE AS threshold, CASE WHEN (n_chars % 101) / 100.0::DOUBLE >= 0.5 THEN 'KEEP' ELSE 'DROP' END AS decision FROM documents")
def bleu_gate(spark, sf):
    rows = A.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("table_id"), F.col("lang").alias("lang_code"), (F.col("n_chars") % 101 / 100.0).alias("bleu_score"))
    return worklists.bleu_gate(rows, 0.5)


@query("question_ids", _with(A.TABLES_SQL) + "SELECT printf('%s_%03d', table_id, i + 1) AS question_id, table_id, line AS pair FROM (SELECT table_id, unnest(range(len(data))) AS i, array_to_string(unnest(data), ' | ') AS line FROM tables)")
def question_ids(spark, sf):
    rows = A.tables(spark, sf).select("table_id", F.transform("data", lambda r: F.array_join(r, " | ")).alias("pairs"))
    return worklists.question_ids(rows)


@query("evidence_cells", _with(A.TABLES_SQL) + "SELECT table_id || '_001' AS question_id, ref, cell FROM (SELECT table_id, 'A1' AS ref, data[1][1] AS cell FROM tables UNION ALL SELECT table_id, 'B2', data[2][2] FROM tables WHERE len(data) > 1 AND len(data[2]) > 1)")
def evidence_cells(spark, sf):
    tables = A.tables(spark, sf)
    pairs = tables.select("table_id", F.concat("table_id", F.lit("_001")).alias("question_id"), F.array(F.lit("A1"), F.lit("B2")).alias("evidence_cells"))
    return worklists.evidence(pairs, scoring.cells(tables))


@query("review_status_shares", _with(A.REVIEWS_SQL) + "SELECT is_golden_correct, count(*) AS rows, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent FROM reviews GROUP BY is_golden_correct")
def review_status_shares(spark, sf):
    return worklists.shares(A.reviews(spark, sf), "is_golden_correct")


_TYPE = "CASE WHEN contains(f, 'arxiv') THEN 'arxiv' WHEN contains(f, 'finqa') THEN 'finqa' WHEN contains(f, 'wiki') THEN 'wikitq' WHEN contains(f, 'tat') THEN 'tat-qa' WHEN contains(f, 'multihiertt') THEN 'multihiertt' ELSE 'unknown' END"


@query("review_dataset_types", _with(A.REVIEWS_SQL) + f"SELECT question_id, {_TYPE} AS dataset, regexp_replace(question_id, '_[^_]*$', '') AS table_id FROM (SELECT question_id, split_part(lower(question_id), '_', 1) AS f FROM reviews)")
def review_dataset_types(spark, sf):
    q = F.col("question_id")
    return A.reviews(spark, sf).select("question_id", worklists.dataset_type(q).alias("dataset"), worklists.table_of(q).alias("table_id"))


@query("review_filter", _with(A.REVIEWS_SQL) + "SELECT doc_id, question_id, is_golden_correct FROM reviews WHERE is_golden_correct = 'Incorrect' AND split_part(question_id, '_', 1) = 'finqa'")
def review_filter(spark, sf):
    return worklists.reviews(A.reviews(spark, sf), "Incorrect", "finqa")


@query("review_page", _with(A.REVIEWS_SQL) + "SELECT * FROM reviews ORDER BY doc_id OFFSET 20 LIMIT 10")
def review_page(spark, sf):
    return worklists.page(A.reviews(spark, sf), "doc_id", 2, 10)


@query("answer_upsert", _with(A.PAIRS_SQL) + "SELECT id AS question_id, CASE WHEN conv_id % 3 = 0 THEN truth ELSE prediction END AS answer, conv_id % 3 = 0 AND truth <> prediction AS changed FROM pairs")
def answer_upsert(spark, sf):
    pairs = A.pairs(spark, sf)
    return worklists.upsert_answers(pairs.select(F.col("id").alias("question_id"), F.col("prediction").alias("answer")), pairs.where("conv_id % 3 = 0").select(F.col("id").alias("question_id"), F.col("truth").alias("answer")))


# Collection ------------------------------------------------------------------------------------------------------


_GATED = """sized AS (SELECT table_id, CASE WHEN file_name LIKE 'github%' THEN 'github' ELSE source END AS source, len(data) AS n, len(data[1]) AS m,
  len(list_filter(flatten(data), lambda c: c = '')) AS z, len(list_filter(data[1], lambda c: starts_with(c, 'Unnamed'))) AS u FROM tables),
gated AS (SELECT *, CASE WHEN source = 'github' THEN n >= 2 AND m >= 2 AND u <= m * 0.5 AND z < n * m ELSE n >= 3 AND m >= 3 AND z::DOUBLE / greatest(n * m, 1) <= 0.8 END AS ok FROM sized)"""


def _gated(spark, sf):
    """Tables with empty cells as nulls, a quarter of them from a code host."""
    tables = A.tables(spark, sf).withColumn("source", F.when(F.col("file_name").startswith("github"), "github").otherwise(F.col("source")))
    return collect.gated(tables.withColumn("data", F.transform("data", lambda r: F.transform(r, lambda c: F.nullif(c, F.lit(""))))))


@query("quality_gate", _with(A.TABLES_SQL, _GATED) + "SELECT table_id, ok AS accepted FROM gated")
def quality_gate(spark, sf):
    return _gated(spark, sf).select("table_id", "accepted")


@query(
    "content_new_to_a_run",
    """SELECT source, min(doc_id::VARCHAR) AS kept, count(*) AS copies FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents e JOIN labels l ON e.doc_id = l.doc_id WHERE l.quality = 1 AND e.source = d.source AND e.text = d.text) GROUP BY source, text""",
)
def content_new_to_a_run(spark, sf):
    """A first run collects the tables whose label is 1, a second one all tables: what is new to it."""
    store = stores.KeyStore(spark, stores.scratch(spark, "content"), "source string, digest string")
    first = A.tables(spark, sf).join(_labels(spark, sf).where("quality = 1"), "table_id", "left_semi")
    store.add(collect.new_content(first, store))
    return collect.new_content(A.tables(spark, sf), store).select("source", "kept", "copies")


@query("answer_corrections", _with(A.PAIRS_SQL) + "SELECT id AS question_id, prediction AS old, truth AS new, 0::BIGINT AS run FROM pairs WHERE conv_id % 3 = 0 AND truth <> prediction")
def answer_corrections(spark, sf):
    """A third of the answers is corrected in the store; the log tells what changed."""
    pairs = A.pairs(spark, sf)
    store = stores.AnswerStore(spark, stores.scratch(spark, "answers"))
    store.create(pairs.select(F.col("id").alias("question_id"), F.col("prediction").alias("answer")))
    store.correct(pairs.where("conv_id % 3 = 0").select(F.col("id").alias("question_id"), F.col("truth").alias("answer")))
    return store.log().select("question_id", "old", "new", "run")


@query("answers_after_corrections", _with(A.PAIRS_SQL) + "SELECT id AS question_id, CASE WHEN conv_id % 3 = 0 THEN truth ELSE prediction END AS answer FROM pairs")
def answers_after_corrections(spark, sf):
    pairs = A.pairs(spark, sf)
    store = stores.AnswerStore(spark, stores.scratch(spark, "answers"))
    store.create(pairs.select(F.col("id").alias("question_id"), F.col("prediction").alias("answer")))
    store.correct(pairs.where("conv_id % 3 = 0").select(F.col("id").alias("question_id"), F.col("truth").alias("answer")))
    return store.answers()


@query("review_page_of_store", _with(A.REVIEWS_SQL) + "SELECT * FROM reviews ORDER BY is_golden_correct, doc_id OFFSET 30 LIMIT 10")
def review_page_of_store(spark, sf):
    """The fourth page of ten reviews, from a store that is sorted once."""
    pages = stores.Pages(spark, stores.scratch(spark, "reviews"))
    pages.build(A.reviews(spark, sf), ["is_golden_correct", "doc_id"])
    return pages.page(3, 10)


@query("content_hash_dedup", "SELECT source, min(doc_id::VARCHAR) AS kept, count(*) AS copies FROM documents GROUP BY source, text")
def content_hash_dedup(spark, sf):
    return collect.distinct_content(A.tables(spark, sf)).select("source", "kept", "copies")


@query("collection_target", "SELECT source, table_id FROM (SELECT source, doc_id::VARCHAR AS table_id FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY table_id) <= 5")
def collection_target(spark, sf):
    return collect.up_to(A.tables(spark, sf).select("source", "table_id"), 5)


@query("url_dedup", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def url_dedup(spark, sf):
    return A.read(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query(
    "table_statistics",
    _with(A.TABLES_SQL)
    + """SELECT table_id, len(data[1])::BIGINT AS total_columns, n AS numeric_columns, (len(data[1]) - n)::BIGINT AS text_columns, round(n * 1.0::DOUBLE / len(data[1]), 4) AS numeric_share, array_to_string(data[1][1:20], '|') AS first_columns
  FROM (SELECT *, len(list_filter(range(1, len(data[1]) + 1), lambda j: len(list_filter(data, lambda r: r[j] IS NOT NULL AND try_cast(r[j] AS DOUBLE) IS NULL)) = 0))::BIGINT AS n FROM tables)""",
)
def table_statistics(spark, sf):
    found = collect.table_statistics(A.tables(spark, sf))
    return found.select("table_id", "total_columns", "numeric_columns", "text_columns", "numeric_share", F.array_join("column_names", "|").alias("first_columns"))


@query(
    "column_types",
    """SELECT p_brand AS table_id, count(*) AS num_rows, 5 * count(*) AS num_cells, 5::BIGINT AS total_columns, 3::BIGINT AS numeric_columns, 1 + (NOT bool_and(p_partkey % 89 <> 0))::BIGINT AS text_columns, 0.6::DOUBLE AS numeric_share, 'name|size|price|none|even' AS column_names,
  'even=' || CASE WHEN bool_and(p_partkey % 89 <> 0) THEN 'bool' ELSE 'object' END || '|name=object|none=float64|price=float64|size=' || CASE WHEN bool_and(p_partkey % 97 <> 0) THEN 'int64' ELSE 'float64' END AS data_types FROM part GROUP BY p_brand""",
)
def column_types(spark, sf):
    """A table of each brand's parts: names, sizes (some missing), prices, nothing, and truths (some missing)."""
    key = F.col("p_partkey")
    row = F.array("p_name", F.when(key % 97 != 0, F.col("p_size").cast("string")), F.col("p_retailprice").cast("string"), F.lit(None).cast("string"), F.when(key % 89 != 0, F.when(F.col("p_size") % 2 == 0, "True").otherwise("False")))
    tables = A.read(spark, sf, "part").select("p_brand", row.alias("row")).groupBy(F.col("p_brand").alias("table_id")).agg(F.collect_list("row").alias("data"))
    found = collect.table_statistics(tables.withColumn("columns", F.array(*(F.lit(c) for c in ("name", "size", "price", "none", "even")))))
    types = F.array_join(F.array_sort(F.transform(F.map_entries("data_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return found.withColumns({"column_names": F.array_join("column_names", "|"), "data_types": types})


_NOTE = """o_orderkey::VARCHAR || ', "' || o_orderdate || '"; | ' || chr(10) || o_orderpriority"""


@query("csv_sniff", f"SELECT o_orderkey, ['|', ';', ','][o_orderkey % 3 + 1] AS delimiter, 4::BIGINT AS n_columns, 'Unnamed: 3' AS last_header, 2::BIGINT AS n_rows, o_orderstatus AS first_cell, {_NOTE} AS note, NULL::VARCHAR AS short FROM orders")
def csv_sniff(spark, sf):
    d = F.element_at(F.array(F.lit("|"), F.lit(";"), F.lit(",")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    note = F.concat(F.col("o_orderkey").cast("string"), F.lit(', "'), F.col("o_orderdate").cast("string"), F.lit('"; | \n'), "o_orderpriority")
    quoted = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    head, row = F.concat(F.lit("status"), d, F.lit("note"), d, F.lit("n"), d), F.concat("o_orderstatus", d, quoted, d, F.lit("1"), d, F.lit("x"))
    content = F.concat(head, F.lit("\r\n"), row, F.lit("\n\n"), row, d, F.lit("too many\n"), F.lit("short"), d, F.lit('""\n'))
    out = collect.sniff_csv(A.read(spark, sf, "orders").select("o_orderkey", content.alias("content")))
    first, second = F.col("data")[0], F.col("data")[1]
    return out.select("o_orderkey", "delimiter", F.size("columns").cast("long").alias("n_columns"), F.col("columns")[3].alias("last_header"), F.size("data").cast("long").alias("n_rows"), first[0].alias("first_cell"), first[1].alias("note"), F.coalesce(second[1], second[3]).alias("short"))


@query(
    "html_tables",
    """SELECT p_partkey, k AS table_no, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand WHEN 3 THEN '' ELSE p_name END AS caption, CASE k WHEN 4 THEN '0' ELSE p_brand END AS first_header, p_type AS first_cell
  FROM part, range(0, 5) AS r(k)""",
)
def html_tables(spark, sf):
    """A caption within, one before by its class, one of the figure that comes after, a stray one that isn't the table's, and a table without header."""
    name, brand, kind = (render.escape(F.col(c)) for c in ("p_name", "p_brand", "p_type"))
    row = F.concat(F.lit("<tr><td>"), kind, F.lit("</td><td>1</td></tr></table>"))
    rest = F.concat(F.lit("<tr><th>"), brand, F.lit("</th><th>n</th></tr>"), row)
    page = F.concat(
        F.lit("<p>x<br>y</p><table><caption>"), name, F.lit("</caption>"), rest, F.lit("<div class='a caption'>"), kind, F.lit("</div><table><thead>"), F.replace(rest, F.lit("</tr><tr>"), F.lit("</tr></thead><tr>")),
        F.lit("<figure><div><table>"), rest, F.lit("</div><figcaption>"), brand, F.lit("</figcaption></figure><figcaption>stray</figcaption><p>z</p><table>"), rest, F.lit("<figcaption>"), name, F.lit("</figcaption><table>"), row,
    )
    parts = A.read(spark, sf, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file holds many pages
    out = collect.html_tables(parts.select("p_partkey", page.alias("html")))
    return out.select("p_partkey", "table_no", "caption", F.col("columns")[0].alias("first_header"), F.col("data")[0][0].alias("first_cell"))


@query(
    "print_tables",
    """SELECT o_custkey AS page, 0 AS table_no, 'Order|Status|Order priority|Total' AS columns,
  string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || '|' || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE floor(o_totalprice)::BIGINT::VARCHAR END, ';' ORDER BY o_orderkey) AS data,
  'Table of ' || o_custkey AS caption FROM orders GROUP BY o_custkey""",
)
def print_tables_query(spark, sf):
    """Each customer's orders as words on a page: below a caption and prose of two lines, a header and a line for each, the total ranged right and sometimes missing."""
    orders = A.read(spark, sf, "orders").withColumn("line", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    box = lambda text, x, y, width=None: F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in (("x1", x), ("y1", y), ("x2", x + F.length(text) * 5 if width is None else x + width), ("y2", y + 10))), text.alias("text"))
    total = F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice").cast("string"))
    y = F.lit(140) + F.col("line") * 12
    first, second = F.split_part("o_orderpriority", F.lit(" "), F.lit(1)), F.split_part("o_orderpriority", F.lit(" "), F.lit(2))
    body = orders.select("o_custkey", F.explode(F.array(box(F.col("o_orderkey").cast("string"), F.lit(50), y), box(F.col("o_orderstatus"), F.lit(150), y), box(first, F.lit(220), y), box(second, F.lit(223) + F.length(first) * 5, y), box(total, F.lit(400) - F.length(total) * 5, y))).alias("w"))
    fixed = [("Order", 50, 140), ("Status", 150, 140), ("Order", 220, 140), ("priority", 248, 140), ("Total", 375, 140)]
    prose = [(f"word{k}", 50 + 33 * (k % 10), 60 + 12 * (k // 10), 30) for k in range(20)]
    head = orders.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(*(box(F.lit(t[0]), F.lit(t[1]), F.lit(t[2]), *t[3:]) for t in fixed + prose))).alias("w"))
    words = body.unionByName(head).select(F.col("o_custkey").alias("page"), "w.*")
    tables = print_tables.grid_tables(words)
    blocks = orders.select(F.col("o_custkey").alias("page")).distinct().select("page", F.lit(0).alias("block"), *(F.lit(float(v)).alias(c) for c, v in (("x1", 50), ("y1", 100), ("x2", 300), ("y2", 112))), F.concat(F.lit("Table of "), "page").alias("text"))
    rows = F.array_join(F.transform("data", lambda r: F.array_join(r, "|", "-")), ";")
    return print_tables.captioned(tables, blocks).select("page", "table_no", F.array_join("columns", "|").alias("columns"), rows.alias("data"), "caption")


@query("caption_join", "SELECT doc_id AS page, 0 AS table_no, min(source) AS caption FROM (SELECT doc_id, 'Table ' || source AS source FROM documents WHERE n_chars % 200 <= 100) GROUP BY doc_id")
def caption_join(spark, sf):
    docs = A.read(spark, sf, "documents")
    tables = docs.select(F.col("doc_id").alias("page"), F.lit(0).alias("table_no"), F.lit(0.0).alias("x1"), F.lit(300.0).alias("y1"))
    y = F.lit(300.0) - F.col("n_chars") % 200
    blocks = docs.select(F.col("doc_id").alias("page"), F.lit(0).alias("block"), F.lit(20.0).alias("x1"), y.alias("y1"), y.alias("y2"), F.concat(F.lit("Table "), "source").alias("text"))
    return collect.captions(tables, blocks)


@query("response_parse", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'said ' || url ELSE '<think>hm</think> said ' || url END AS answer FROM pages")
def response_parse(spark, sf):
    k = F.col("page_id") % 3
    said = F.when(k == 0, F.concat(F.lit('<think>hm</think>```json\n{"data": [["'), "url", F.lit('"]]}\n```'))).when(k == 1, F.concat(F.lit("said "), "url")).otherwise(F.concat(F.lit("<think>hm</think> said "), "url"))
    return worklists.parsed_responses(A.read(spark, sf, "pages").select("page_id", said.alias("response"))).select("page_id", F.col("answer")[0][0].alias("answer"))


@query("translation_prompts", _with(A.TABLES_SQL) + "SELECT table_id, 'Translate headers and cells to ' || lang || '. Keep numbers, symbols and the shape. Answer as JSON with columns and data.' AS asked, array_to_string(data[1], '|') AS header, array_to_string(list_transform(data, lambda r: array_to_string(r, '|')), chr(10)) AS cells FROM tables")
def translation_prompts(spark, sf):
    """What is asked, and the table that the prompt holds, read back."""
    t = A.tables(spark, sf).withColumn("prompt", worklists.translation_prompt(F.col("columns"), F.col("data"), F.col("lang")))
    parts = F.split("prompt", "\n", 2)
    table = F.from_json(parts[1], "columns array<string>, data array<array<string>>")
    return t.select("table_id", parts[0].alias("asked"), F.array_join(table["columns"], "|").alias("header"), F.array_join(F.transform(table["data"], lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query("kept_files", "SELECT doc_id || '.json' AS file_name, CASE WHEN doc_id % 3 <> 0 THEN 'a/' || doc_id || '.json' END AS path FROM documents")
def kept_files(spark, sf):
    name = F.concat("doc_id", F.lit(".json"))
    docs = A.read(spark, sf, "documents").select("doc_id", name.alias("file_name"))
    files = docs.where("doc_id % 3 <> 0").select("file_name", F.explode(F.array(F.concat(F.lit("b/"), "file_name"), F.concat(F.lit("a/"), "file_name"))).alias("path"))
    return collect.located(docs, files)


@query("collection_counters", _with(A.TABLES_SQL, _GATED) + "SELECT source, count(*) AS seen, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok AND (n < 3 OR m < 3)) AS too_small, count(*) FILTER (NOT ok AND n >= 3 AND m >= 3) AS too_empty FROM gated GROUP BY source")
def collection_counters(spark, sf):
    return collect.counters(_gated(spark, sf))


_COUNTERS = SQL["collection_counters"]


@query("counters_while_writing", _COUNTERS)
def counters_while_writing(spark, sf):
    """The counters of the tables that one pass gates, counts and writes."""
    tables, observation = collect.counted(_gated(spark, sf), [*(f"src{i}" for i in range(20)), "github"])
    tables.where("accepted").write.parquet(stores.scratch(spark, "accepted"))
    return collect.observed_counters(observation, spark)


@query("tables_from_cells", _with(A.TABLES_SQL) + "SELECT table_id, array_to_string(list_transform(data, lambda r: array_to_string(r, ' | ')), chr(10)) AS text FROM tables")
def tables_from_cells(spark, sf):
    back = scoring.from_cells(scoring.cells(A.tables(spark, sf)))
    return back.select("table_id", F.array_join(F.transform("data", lambda r: F.array_join(r, " | ")), "\n").alias("text"))


_PLAN = f"plan AS (SELECT q.doc_id::VARCHAR AS table_id, l AS lang_code, CASE WHEN q.doc_id % 5 = 0 THEN 'failed' WHEN d.table_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS status FROM (SELECT * FROM documents, unnest({FEW!r}) AS u(l)) q LEFT JOIN done d ON q.doc_id::VARCHAR = d.table_id AND q.l = d.lang_code)"


def _plan(spark, sf):
    tables = A.tables(spark, sf).select("table_id")
    return translate.question_plan(tables, tables.where(F.col("table_id").cast("long") % 5 != 0), _done(spark, sf), FEW)


@query("question_plan", _with(_DONE, _PLAN) + "SELECT * FROM plan")
def question_plan(spark, sf):
    return _plan(spark, sf)


@query("run_statistics", _with(_DONE, _PLAN) + "SELECT status, count(*) AS rows FROM plan GROUP BY status")
def run_statistics(spark, sf):
    return translate.run_statistics(_plan(spark, sf))


def _lower() -> "translate.Client":
    return lambda prompt: prompt.partition("\n")[2].lower()


@query("translation_round_trip", _with(A.TABLES_SQL) + "SELECT table_id, 'fr' AS lang_code, array_to_string(list_transform(data, lambda r: array_to_string(list_transform(r, lambda c: CASE WHEN doc_id % 3 = 0 THEN c ELSE lower(c) END), '|')), chr(10)) AS cells FROM tables")
def translation_round_trip(spark, sf):
    """A step with a client that answers in lower case, of which a third is done already."""
    work = A.tables(spark, sf).select("table_id", F.lit("fr").alias("lang_code"), "columns", "data")
    done = work.where(F.col("table_id").cast("long") % 3 == 0)
    return translate.step(work, done, translate.table_prompt(F.col("lang_code")), lambda: _lower()).select("table_id", "lang_code", F.array_join(F.transform("data", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query(
    "eval_summary",
    _with(*_UP_TO_SCORED, "languages AS (SELECT language, count(*) AS n, round(avg(bleu_score), 6) AS bleu FROM scored GROUP BY language)")
    + """SELECT (SELECT 'model_' || conv_id % 3 FROM conversations WHERE role = 'assistant' ORDER BY conv_id * 1000 + turn LIMIT 1) AS model_name, (SELECT count(*) FROM tagged) AS total_responses, (SELECT count(*) FROM tagged WHERE outcome = 'processed') AS processed,
  (SELECT count(*) FROM scored) AS samples, (SELECT round(avg(exact_match), 6) FROM scored) AS exact_match, (SELECT round(avg(f1_score), 6) FROM scored) AS f1_score, (SELECT round(avg(bleu_score), 6) FROM scored) AS bleu_score,
  (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM languages) AS languages, (SELECT max(bleu) FROM languages) AS best_bleu""",
)
def eval_summary(spark, sf):
    """The written summary, read back: model, counters, overall metrics, the languages and the best mean BLEU of one."""
    tagged = _tagged(spark, sf)
    means = "samples BIGINT, exact_match DOUBLE, f1_score DOUBLE, bleu_score DOUBLE"
    kind = f"model_name STRING, metadata STRUCT<total_responses: BIGINT, processed: BIGINT>, overall_metrics STRUCT<{means.replace(' BIGINT', ': BIGINT').replace(' DOUBLE', ': DOUBLE')}>, per_language_metrics ARRAY<STRUCT<language: STRING, {means.replace(' BIGINT', ': BIGINT').replace(' DOUBLE', ': DOUBLE')}>>"
    read = evaluate.summary(tagged, evaluate.score(tagged)).select(F.from_json("summary", kind).alias("s")).select("s.*")
    languages = F.array_join(F.transform("per_language_metrics", lambda m: F.concat(m["language"], F.lit("="), m["samples"])), ",")
    return read.select("model_name", "metadata.*", "overall_metrics.*", languages.alias("languages"), F.array_max("per_language_metrics.bleu_score").alias("best_bleu"))


# Rendering -------------------------------------------------------------------------------------------------------

_ESCAPED = "replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "html_render",
    _with(A.TABLES_SQL)
    + f"""SELECT table_id, '<table><thead><tr>' || array_to_string(list_transform(data[1], lambda c, j: '<th id="cell-h-' || (j - 1) || '">' || {_ESCAPED} || '</th>'), '') || '</tr></thead><tbody>' ||
  array_to_string(list_transform(data, lambda r, i: '<tr>' || array_to_string(list_transform(r, lambda c, j: '<td id="cell-r' || (i - 1) || '-c' || (j - 1) || '">' || {_ESCAPED} || '</td>'), '') || '</tr>'), '') || '</tbody></table>' AS html FROM tables""",
)
def html_render(spark, sf):
    return A.tables(spark, sf).select("table_id", render.html(F.col("columns"), F.col("data")).alias("html"))


def _style_sql(style: str) -> str:
    def pick(values, i: str) -> str:
        return f"""[{', '.join("'" + v.replace("'", "''") + "'" for v in values)}][({i}) % {len(values)} + 1]"""

    n, m = len(render.FONTS), len(render.COLOURS)
    page, head, row = (pick([c[k] for c in render.COLOURS], f"{style} // {n}") for k in range(3))
    return f"""'body {{ background: ' || {page} || '; font-family: ' || {pick(render.FONTS, style)} || '; }} table {{ border-collapse: collapse; }} td, th {{ padding: 4px 8px; }} th {{ background: ' || {head} || '; }} tr:nth-child(even) {{ background: ' || {row} || '; }} ' || {pick(render.LINES, f'{style} // {n * m}')}"""


@query(
    "html_pages",
    SQL["html_render"].replace("AS html FROM tables", "AS html FROM tables), styled AS (SELECT table_id, html, floor(('0x' || substr(md5(table_id || '|style'), 1, 12))::BIGINT / 16::DOUBLE ** 12 * 60)::INT AS style FROM plain").replace("SELECT table_id, '<table>", ", plain AS (SELECT table_id, '<table>", 1)
    + f""") SELECT table_id, style, '<!DOCTYPE html><html><head><meta charset="utf-8"><style>' || {_style_sql('style')} || '</style></head><body>' || html || '</body></html>' AS page FROM styled""",
)
def html_pages(spark, sf):
    """Every table as a page in the style that its name draws."""
    rows = A.tables(spark, sf).withColumn("style", render.style_of(F.col("table_id")))
    return rows.select("table_id", "style", render.page(F.col("columns"), F.col("data"), F.col("style")).alias("page"))


@query("render_worklist", f"SELECT *, floor(('0x' || substr(md5(table_id || '/' || image_filename || '|style'), 1, 12))::BIGINT / 16::DOUBLE ** 12 * {render.STYLES})::INT AS style FROM (SELECT doc_id::VARCHAR AS table_id, lang || '_' || k || '.jpg' AS image_filename FROM documents, (VALUES ('clean'), ('noise1'), ('noise2'), ('noise3')) AS v(k))")
def render_worklist(spark, sf):
    return render.render_worklist(A.tables(spark, sf)).select("table_id", "image_filename", "style")


def _draw_sql(name: str) -> str:
    return f"(('0x' || substr(md5(k || '|{name}'), 1, 12))::BIGINT / 16::DOUBLE ** 12)"


@query(
    "noise_plan",
    "SELECT table_id, image_filename, "
    + ", ".join(f"round({float(a)}::DOUBLE + {_draw_sql(n)} * {float(b - a)!r}::DOUBLE, 6) AS {n}" for n, (a, b) in render.REAL.items())
    + ", "
    + ", ".join(f"({a} + floor({_draw_sql(n)} * {b - a + 1}))::INT AS {n}" for n, (a, b) in render.WHOLE.items())
    + ", array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {_draw_sql('stage ' + n)} < {float(p)!r}::DOUBLE THEN '{n}' END" for n, p in render.STAGES.items())
    + "], lambda x: x IS NOT NULL), '>') AS stages FROM (SELECT *, table_id || '/' || image_filename AS k FROM (SELECT doc_id::VARCHAR AS table_id, lang || '_' || n || '.jpg' AS image_filename FROM documents, (VALUES ('noise1'), ('noise2'), ('noise3')) AS v(n)))",
)
def noise_plan(spark, sf):
    return render.noise_plan(render.render_worklist(A.tables(spark, sf)))
