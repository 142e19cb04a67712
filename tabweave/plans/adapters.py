"""The tables of the driver in the shapes of the data model, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = ["en", "fr", "it", "es"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as tables: rows are lines, cells are parted by ' | ', the header is the first row; with a file name that holds a source."""
    docs = read(spark, sf_dir, "documents")
    rows = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, r" \| ", -1))
    names = F.array(*(F.lit(x) for x in ("arxiv", "wikisql", "finqa", "github_csv")))
    name = F.concat(F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")), F.lit("_"), F.col("doc_id"), F.lit(".json"))
    return docs.select(F.col("doc_id").cast("string").alias("table_id"), F.col("source").alias("category"), "source", "lang", name.alias("file_name"), rows.alias("data")).withColumn("columns", F.get("data", F.lit(0)))


TABLES_SQL = """tables AS (
  SELECT doc_id, doc_id::VARCHAR AS table_id, source AS category, source, lang,
    ['arxiv', 'wikisql', 'finqa', 'github_csv'][doc_id % 4 + 1] || '_' || doc_id || '.json' AS file_name,
    list_transform(string_split(text, chr(10)), lambda line: string_split(line, ' | ')) AS data,
    length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::BIGINT AS chars
  FROM documents)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns (prediction) with the user turn before (truth)."""
    conv = read(spark, sf_dir, "conversations")
    said = conv.where("role = 'assistant'").select("conv_id", "turn", F.lower("text").alias("prediction"))
    asked = conv.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lower("text").alias("truth"))
    return said.join(asked, ["conv_id", "turn"]).withColumn("id", F.format_string("%s_%03d", "conv_id", "turn"))


PAIRS_SQL = """pairs AS (
  SELECT printf('%d_%03d', a.conv_id, a.turn) AS id, a.conv_id, a.turn, lower(a.text) AS prediction, lower(u.text) AS truth
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE a.role = 'assistant' AND u.role = 'user')"""


def language(conv_id):
    return F.element_at(F.array(*(F.lit(x) for x in LANGS)), (conv_id % 4 + 1).cast("int"))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: user turns; the last of those that share conversation and language wins."""
    conv = read(spark, sf_dir, "conversations").where("role = 'user'")
    return conv.select(F.concat(F.lit("q_"), "conv_id").alias("question_id"), F.col("conv_id").cast("string").alias("table_id"), language(F.col("conv_id")).alias("language"), F.lower("text").alias("golden_answer"), F.col("turn").alias("line_no"))


DATASET_SQL = f"""dataset AS (
  SELECT 'q_' || conv_id AS question_id, conv_id::VARCHAR AS table_id, {LANGS!r}[conv_id % 4 + 1] AS language, lower(text) AS golden_answer, turn AS line_no
  FROM conversations WHERE role = 'user')"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as responses, some of them errors, of unknown language or unreadable, each with its line and model."""
    conv = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    c = F.col("conv_id")
    code = F.when(c % 7 == 0, "xx").otherwise(language(c))
    said = F.when(c % 11 == 0, "CUDA out of memory. Skipping.").when(c % 13 == 0, "Table too large").otherwise(F.lower("text"))
    return conv.select(F.format_string("%s_%03d", c, "turn").alias("response_id"), F.concat(F.lit("q_"), c).alias("question_id"), F.concat(code, F.lit("_clean.jpg")).alias("image_filename"), said.alias("model_response"), (c % 17 != 0).alias("parsed"), (c * 1000 + F.col("turn")).alias("line_no"), F.concat(F.lit("model_"), c % 3).alias("model_name"))


RESPONSES_SQL = f"""responses AS (
  SELECT printf('%d_%03d', conv_id, turn) AS response_id, 'q_' || conv_id AS question_id, CASE WHEN conv_id % 7 = 0 THEN 'unknown' ELSE {LANGS!r}[conv_id % 4 + 1] END AS language,
    CASE WHEN conv_id % 11 = 0 THEN 'CUDA out of memory. Skipping.' WHEN conv_id % 13 = 0 THEN 'Table too large' ELSE lower(text) END AS model_response, conv_id % 17 <> 0 AS parsed
  FROM conversations WHERE role = 'assistant')"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean and three noisy images of each conversation in each of its two languages."""
    conv = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    kinds = F.array(*(F.struct(F.lit(t).alias("image_type"), F.lit(k).alias("kind")) for t, k in (("clean", "clean"), ("noise", "noise1"), ("noise", "noise2"), ("noise", "noise3"))))
    rows = conv.select("conv_id", F.explode(F.array(language(F.col("conv_id")), language(F.col("conv_id") + 1))).alias("lang")).select("conv_id", "lang", F.explode(kinds).alias("x"))
    return rows.select(F.col("conv_id").cast("string").alias("table_id"), "x.image_type", F.concat("lang", F.lit("_"), "x.kind", F.lit(".jpg")).alias("image_filename"))


IMAGES_SQL = f"""images AS (
  SELECT conv_id::VARCHAR AS table_id, k.t AS image_type, lang || '_' || k.k || '.jpg' AS image_filename, lang AS language
  FROM (SELECT conv_id, unnest([{LANGS!r}[conv_id % 4 + 1], {LANGS!r}[(conv_id + 1) % 4 + 1]]) AS lang FROM (SELECT DISTINCT conv_id FROM conversations)),
  (VALUES ('clean', 'clean'), ('noise', 'noise1'), ('noise', 'noise2'), ('noise', 'noise3')) AS k(t, k))"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as reviews."""
    names = F.array(*(F.lit(x) for x in ("arxiv", "finqa", "wikisql", "tatqa", "multihiertt", "misc")))
    question = F.concat(F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_001"))
    status = F.when(F.col("toxic") == 1, "Needs_Revision").when(F.col("quality") == 1, "Correct").otherwise("Incorrect")
    return read(spark, sf_dir, "labels").select("doc_id", question.alias("question_id"), status.alias("is_golden_correct"))


REVIEWS_SQL = """reviews AS (
  SELECT doc_id, ['arxiv', 'finqa', 'wikisql', 'tatqa', 'multihiertt', 'misc'][doc_id % 6 + 1] || '_' || doc_id || '_001' AS question_id,
    CASE WHEN toxic = 1 THEN 'Needs_Revision' WHEN quality = 1 THEN 'Correct' ELSE 'Incorrect' END AS is_golden_correct
  FROM labels)"""
