"""Writers. Nothing is ever deleted or changed in place: what is kept is written to another folder."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import append_lines, write_text


def tables(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Table documents as JSON lines, by source if there is one. Returns how many there are by source; a dry run counts and writes nothing."""
    if not dry_run:
        writer = df.write.mode("overwrite")
        (writer.partitionBy("source") if "source" in df.columns else writer).json(path)
    return df.groupBy("source").count() if "source" in df.columns else df.groupBy().count()


def with_metadata(df: DataFrame, path: str, about: DataFrame, key: str = "table_id") -> None:
    """The tables, and beside them the metadata rows of those that were kept."""
    tables(df, f"{path}/tables")
    about.join(df.select(key).distinct(), key, "left_semi").write.mode("overwrite").json(f"{path}/metadata")


def report(df: DataFrame, path: str) -> None:
    """A small aggregate as JSON lines in one file."""
    df.coalesce(1).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


# Headers of the printed summary, by column.
SUMMARY = {
    "category": "Category", "tables": "Tables", "min_score": "Min Score", "max_score": "Max Score", "avg_score": "Avg Score", "avg_rows": "Avg Rows", "avg_columns": "Avg Cols",
    "score_10": "Score 10", "score_9": "Score 9", "score_8": "Score 8", "metadata_files": "Metadata Files",
}


def csv_summary(df: DataFrame, path: str) -> None:
    """The printed summary (a row for each category) as one CSV file, in order of category."""
    df.select(*(F.col(c).alias(h) for c, h in SUMMARY.items())).orderBy(SUMMARY["category"]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results as JSON lines beside what is there; a failed job leaves nothing visible."""
    df.write.mode("append").json(path)


def result_path(root: str, model: str, language: str, now) -> str:
    """Folder of a run, by model, language and time (a datetime)."""
    return f"{root}/{model.replace('/', '_')}_{language}_{now:%Y%m%d_%H%M%S}"


def evaluation(scored: DataFrame, counters: DataFrame, overall: DataFrame, per_language: DataFrame, folder: str, dataset_file: str, response_file: str, model: str | None = None) -> None:
    """The pair of results of a run: metrics_<response file>, a folder of JSON lines with a row for each scored response, and summary_<its stem>.json.

    counters, overall: a row each; per_language: a row for each language. Only these come to the driver.
    """
    append_lines(scored, f"{folder}/metrics_{response_file}")
    seen, means = counters.first().asDict(), overall.first().asDict()
    languages = {r["language"]: {k: v for k, v in r.asDict().items() if k != "language"} for r in per_language.orderBy("language").collect()}
    summary = {
        "metadata": {"model_name": model or "unknown_model", "dataset_file": dataset_file, "response_file": response_file, "total_samples": seen["processed"]},
        "overall_metrics": {
            **{k: means[k] for k in ("exact_match", "f1_score", "bleu_score")}, "processed_samples": seen["processed"], "skipped_samples": seen["skipped"], "no_match_samples": seen["no_match"],
            "parse_errors": seen["parse_error"], "cuda_errors": seen["cuda_errors"], "table_errors": seen["table_errors"], "total_responses": seen["total_responses"],
        },
        "per_language_metrics": languages,
    }
    write_text(f"{folder}/summary_{response_file.rsplit('.', 1)[0]}.json", json.dumps(summary, indent=2, ensure_ascii=False))
