"""Evaluation: data set and responses joined, tagged, scored and summed up."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..functions.answers import answer_text
from ..schema import QA_LANGUAGES

OUTCOMES = ["parse_error", "no_match", "skipped", "processed"]


def image_language(file_name: Column, languages: list[str] = QA_LANGUAGES) -> Column:
    """Language of an image named <language>_clean or <language>_noise<1-3>, else unknown; longer codes are tried first."""
    stem = F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    found = F.regexp_extract(stem, rf"^({'|'.join(sorted(languages, key=lambda x: (-len(x), x)))})_(clean|noise[1-3]?)$", 1)
    return F.when(found != "", found).otherwise("unknown")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows that share a key, the last."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def _is_error(text: Column) -> Column:
    return F.coalesce(text.contains("CUDA out of memory") | text.contains("Table too large"), F.lit(False))


def tag(responses: DataFrame, dataset: DataFrame) -> DataFrame:
    """Every response with the gold answer (if any) and its outcome. responses: question_id, image_filename, model_response, parsed; dataset: question_id, language, golden_answer, line_no."""
    gold = last_wins(dataset.select("question_id", "language", "golden_answer", "line_no"), ["question_id", "language"], "line_no").drop("line_no")
    seen = responses.withColumn("language", image_language(F.col("image_filename")))
    joined = seen.join(gold.withColumn("found", F.lit(True)), ["question_id", "language"], "left")
    outcome = F.when(~F.col("parsed"), "parse_error").when(F.col("found").isNull(), "no_match").when(_is_error(F.col("model_response")), "skipped").otherwise("processed")
    return joined.withColumn("outcome", outcome).drop("found")


def counters(tagged: DataFrame) -> DataFrame:
    text = F.col("model_response")
    return tagged.agg(
        F.count("*").alias("total_responses"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES),
        F.count_if((F.col("outcome") == "skipped") & text.contains("CUDA out of memory")).alias("cuda_errors"),
        F.count_if((F.col("outcome") == "skipped") & text.contains("Table too large")).alias("table_errors"),
    )


def token_overlap(pairs: DataFrame) -> DataFrame:
    """(id, prediction, truth) with exact_match and f1_score by counting tokens relationally: one shuffle of (id, token)."""
    tokens = [pairs.select("id", F.explode(T.tokens(F.col(c))).alias("token"), F.lit(int(c == "prediction")).alias("a"), F.lit(int(c == "truth")).alias("b")) for c in ("prediction", "truth")]
    each = tokens[0].unionByName(tokens[1]).groupBy("id", "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = each.groupBy("id").agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    both, a, b = (F.coalesce(c, F.lit(0)) for c in ("both", "a", "b"))
    f1 = F.when((a == 0) | (b == 0), (a == b).cast("double")).otherwise(both * 2.0 / (a + b))
    return pairs.join(sums, "id", "left").select("id", (F.col("prediction") == F.col("truth")).cast("int").alias("exact_match"), f1.alias("f1_score"))


def score(tagged: DataFrame) -> DataFrame:
    """Processed rows with both answers normalised, and the three metrics."""
    rows = tagged.where("outcome = 'processed'").withColumns({"model_str_normalized": answer_text(F.col("model_response")), "gold_str_normalized": answer_text(F.col("golden_answer"))})
    a, b = "model_str_normalized", "gold_str_normalized"
    return rows.withColumns({"exact_match": (F.col(a) == F.col(b)).cast("int"), "f1_score": M.token_f1(a, b), "bleu_score": M.adaptive_bleu(a, b)})


def _means(places: int) -> list[Column]:
    return [F.count("*").alias("samples"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), places).alias(c) for c in ("exact_match", "f1_score", "bleu_score"))]


def per_language(scored: DataFrame, places: int = 6) -> DataFrame:
    return scored.groupBy("language").agg(*_means(places))


def overall(scored: DataFrame, places: int = 6) -> DataFrame:
    return scored.agg(*_means(places))


def summary(tagged: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: the model (of the first response that names one, by line_no where it is there), counters, and overall and per-language metrics as one JSON text."""
    languages = per_language(scored).agg(F.array_sort(F.collect_list(F.struct("language", "samples", "exact_match", "f1_score", "bleu_score"))).alias("per_language_metrics"))
    names = tagged if "model_name" in tagged.columns else tagged.withColumn("model_name", F.lit(None).cast("string"))
    order = F.struct("line_no" if "line_no" in names.columns else "question_id", "image_filename")
    model = names.agg(F.min_by("model_name", F.when(F.col("model_name").isNotNull(), order)).alias("model_name"))
    parts = [counters(tagged), overall(scored), languages, model]  # one row each
    rows = [p.select(F.lit(1).alias("one"), F.struct(*p.columns).alias(f"part{i}")) for i, p in enumerate(parts)]
    joined = rows[0].join(rows[1], "one").join(rows[2], "one").join(rows[3], "one")
    return joined.select(F.to_json(F.struct(F.col("part3.model_name").alias("model_name"), F.col("part0").alias("metadata"), F.col("part1").alias("overall_metrics"), F.col("part2.per_language_metrics").alias("per_language_metrics"))).alias("summary"))


def instances(questions: DataFrame, images: DataFrame, language: str = "default", image_type: str = "clean", prefix: bool = False) -> DataFrame:
    """Questions with each of their images in their language; for noise, one picked by a hash of its name.

    language `default` takes all; a question without language is English. With `prefix`, any image whose name begins with
    the language and an underscore matches, so that a code also takes those of longer codes.
    """
    q = questions.where("coalesce(table_id, '') <> '' AND coalesce(question_id, '') <> ''").withColumn("language", F.coalesce("language", F.lit("en")))
    if language != "default":
        q = q.where(F.col("language") == language)
    some = images.where(F.col("image_type") == image_type)
    if prefix:
        out = q.join(some, "table_id").where(F.expr("startswith(image_filename, concat(language, '_'))"))
    else:
        out = q.join(some.withColumn("language", image_language(F.col("image_filename"))), ["table_id", "language"])
    if image_type == "noise":
        first = Window.partitionBy("question_id", "language").orderBy(F.md5("image_filename"), "image_filename")
        out = out.withColumn("pick", F.row_number().over(first)).where("pick = 1").drop("pick")
    return out


def remaining(rows: DataFrame, done: DataFrame, keys=("question_id", "image_filename")) -> DataFrame:
    """Rows whose keys aren't done yet; done rows with a missing key count for nothing."""
    known = done.select(*keys).where(" AND ".join(f"coalesce({k}, '') <> ''" for k in keys)).distinct()
    return rows.join(known, list(keys), "left_anti")
