"""What is left to translate, generate and render; gates; questions; reviews."""

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as T
from ..schema import QUESTION_TYPES, REASONING
from ..sources.files import Lines


def by_language(tables: DataFrame, languages: list[str]) -> DataFrame:
    """Every table with every language: an explode of a short list, not a join."""
    return tables.withColumn("lang_code", F.explode(F.array(*(F.lit(x) for x in languages))))


def translation_worklist(tables: DataFrame, languages: list[str], done: DataFrame) -> DataFrame:
    return by_language(tables.select("table_id"), languages).join(done.select("table_id", "lang_code"), ["table_id", "lang_code"], "left_anti")


def complete_tables(done: DataFrame, languages: list[str]) -> DataFrame:
    """Tables done in all languages."""
    return done.where(F.col("lang_code").isin(languages)).groupBy("table_id").agg(F.count_distinct("lang_code").alias("languages")).where(F.col("languages") == len(languages))


def bleu_gate(quality: DataFrame, threshold: float = 0.0) -> DataFrame:
    return quality.withColumns({"threshold": F.lit(float(threshold)), "decision": F.when(F.col("bleu_score") >= threshold, "KEEP").otherwise("DROP")})


def question_ids(rows: DataFrame, pairs: str = "pairs") -> DataFrame:
    """One row per question of each table's list, numbered from 1."""
    out = rows.select("table_id", F.posexplode(pairs).alias("i", "pair"))
    return out.select(F.format_string("%s_%03d", "table_id", F.col("i") + 1).alias("question_id"), "table_id", "pair")


def valid_questions(pairs: DataFrame) -> DataFrame:
    """Pairs with a question, an answer, and a type and category of the known ones, to the letter."""
    return pairs.where(F.col("question").isNotNull() & (F.size("answer") > 0) & F.col("question_type").isin(QUESTION_TYPES) & F.col("reasoning_category").isin(REASONING))


def evidence(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells that each question's references name."""
    refs = pairs.select("question_id", "table_id", F.explode("evidence_cells").alias("ref"))
    refs = refs.withColumns({"row_idx": C.coordinate_row(F.col("ref")), "col_idx": C.coordinate_column(F.col("ref"))})
    return refs.join(cells, ["table_id", "row_idx", "col_idx"]).select("question_id", "ref", "cell")


def by_client(rows: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]], out: str = "answer", at_once: int | None = None, kept_in: str | None = None) -> DataFrame:
    """Adds a model's answer to each row's prompt. client makes one caller per task; a call that fails gives null.

    at_once: how many tasks may call at the same time. kept_in: a folder that all machines see, to which each answered row is also
    written as a JSON line at once, so that the answers of a task that is lost aren't; the next run leaves them out (`evaluate.remaining`).
    """
    job = uuid.uuid4().hex

    def run(batches: Iterator):
        call, lines = client(), Lines(kept_in, job) if kept_in else None
        for frame in batches:
            said = []
            for i, text in enumerate(frame[prompt]):
                try:
                    said.append(call(text))
                except Exception:  # noqa: BLE001  a failed call is a row to be tried again
                    said.append(None)
                if lines and said[-1] is not None:
                    lines.add({c: getattr(x, "tolist", lambda x=x: x)() for c, x in frame.iloc[i].items() if c != prompt} | {out: said[-1]})
            yield frame.assign(**{out: said})

    if at_once:
        rows = rows.repartition(at_once)
    return rows.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"`{out}` string"]))


def echo_client() -> Callable[[str], str]:
    """Answers with the prompt: for tests."""
    return lambda text: text


def translation_prompt(columns: Column, data: Column, language: Column) -> Column:
    return F.concat(F.lit("Translate headers and cells to "), language, F.lit(". Keep numbers, symbols and the shape. Answer as JSON with columns and data.\n"), F.to_json(F.struct(columns.alias("columns"), data.alias("data"))))


def dataset_type(question_id: Column) -> Column:
    first = F.split_part(F.lower(question_id), F.lit("_"), F.lit(1))
    return F.when(first.contains("arxiv"), "arxiv").when(first.contains("finqa"), "finqa").when(first.contains("wiki"), "wikitq").when(first.contains("tat"), "tat-qa").when(first.contains("multihiertt"), "multihiertt").otherwise("unknown")


def table_of(question_id: Column) -> Column:
    return F.regexp_replace(question_id, "_[^_]*$", "")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each value, and their share in per cent of all."""
    counts = rows.groupBy(column).agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(counts.agg(F.sum("rows").alias("all")))).select(column, "rows", F.round(F.col("rows") * 100.0 / F.col("all"), 2).alias("percent"))  # one row


def datasets(rows: DataFrame) -> DataFrame:
    """The distinct data sets of some reviews, in order."""
    return rows.select(dataset_type(F.col("question_id")).alias("dataset")).distinct().orderBy("dataset")


def with_table(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Reviews with the columns and data of their table, null where it isn't there."""
    return rows.withColumn("table_id", table_of(F.col("question_id"))).join(tables.select("table_id", "columns", "data"), "table_id", "left")


def reviews(rows: DataFrame, status: str = "All", dataset: str = "All") -> DataFrame:
    if status != "All":
        rows = rows.where(F.col("is_golden_correct") == status)
    return rows if dataset == "All" else rows.where(dataset_type(F.col("question_id")) == dataset)


def page(rows: DataFrame, order: str, k: int, size: int = 1) -> DataFrame:
    """The k-th page, from 0; the sort keeps only so many rows."""
    return rows.orderBy(order).offset(k * size).limit(size)


def nested_answer(answer: Column) -> Column:
    """An answer given as JSON as rows of cells: a scalar is one cell, a flat list one row."""
    return F.coalesce(F.from_json(answer, "array<array<string>>"), F.when(answer.startswith("["), F.array(F.from_json(answer, "array<string>"))), F.array(F.array(answer)))


def upsert_answers(pairs: DataFrame, corrected: DataFrame) -> DataFrame:
    """Pairs with the corrected answer where there is one, and whether it changed."""
    new = corrected.select("question_id", F.col("answer").alias("new"))
    return pairs.join(new, "question_id", "left").select("question_id", F.coalesce("new", "answer").alias("answer"), F.coalesce(F.col("new") != F.col("answer"), F.lit(False)).alias("changed"))


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.alias("b").join(after.where("changed").alias("a"), "question_id").select("question_id", F.col("b.answer").alias("old"), F.col("a.answer").alias("new"), F.current_timestamp().alias("at"))


def parsed_responses(raw: DataFrame, text: str = "response") -> DataFrame:
    return raw.withColumn("answer", T.response_answer(F.col(text)))
