"""Steps that call models: translation of tables, questions and terms, each resumable, with the calls behind an interface."""

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..schema import REASONING, TABLE
from ..sources.stores import scratch
from . import worklists

STEPS = ("translated", "refined", "returned")
Client = Callable[[], Callable[[str], str]]


def patient(client: Client, attempts: int = 3, wait: float = 1.0, calls: int | None = None, seconds: float = 60.0) -> Client:
    """A client that tries again after growing waits, and makes at most so many calls in any such time, counted within its task."""

    def make() -> Callable[[str], str]:
        call, made = client(), []

        def run(text: str) -> str:
            for attempt in range(attempts):
                if calls and len(made) >= calls:
                    time.sleep(max(0.0, made[-calls] + seconds - time.monotonic()))
                made.append(time.monotonic())
                try:
                    return call(text)
                except Exception:
                    if attempt == attempts - 1:
                        raise
                    time.sleep(wait * 2**attempt)
            raise RuntimeError("no attempt was allowed")

        return run

    return make


def rotating(clients: list[Client]) -> Client:
    """A client that goes to the next of several (as with keys that run out) when one fails, and stays there."""

    def make() -> Callable[[str], str]:
        calls, at = [c() for c in clients], [0]

        def run(text: str) -> str:
            for _ in calls:
                try:
                    return calls[at[0]](text)
                except Exception:  # noqa: BLE001
                    at[0] = (at[0] + 1) % len(calls)
            return calls[at[0]](text)

        return run

    return make


def step(work: DataFrame, done: DataFrame, prompt: Column, client: Client, at_once: int | None = None) -> DataFrame:
    """Rows of (table_id, lang_code, columns, data): those done, and the others as the client answers its prompts.

    An answer must be a table in JSON with as many columns; others are left out, to be tried in the next run.
    """
    keys = ["table_id", "lang_code"]
    todo = work.join(done.select(*keys), keys, "left_anti").withColumn("prompt", prompt)
    said = worklists.by_client(todo.select(*keys, F.size("columns").alias("width"), "prompt"), "prompt", client, at_once=at_once)
    table = F.from_json(T.strip_fence(F.col("answer")), TABLE)
    new = said.withColumn("t", table).where("t.columns IS NOT NULL AND t.data IS NOT NULL AND size(t.columns) = width")
    return done.select(*keys, "columns", "data").unionByName(new.select(*keys, "t.columns", "t.data"))


def quality(original: DataFrame, returned: DataFrame, threshold: float = 0.0) -> DataFrame:
    """BLEU of the cells of tables translated there and back against the original, and the decision."""
    tokens = lambda c, d: F.transform(F.concat(c, F.flatten(d)), lambda x: F.coalesce(x, F.lit("None")))
    both = returned.withColumn("back", tokens(F.col("columns"), F.col("data"))).select("table_id", "lang_code", "back").join(original.withColumn("first", tokens(F.col("columns"), F.col("data"))).select("table_id", "first"), "table_id")
    return worklists.bleu_gate(both.select("table_id", "lang_code", M.table_bleu("back", "first").alias("bleu_score")), threshold)


def table_prompt(language: Column) -> Column:
    return worklists.translation_prompt(F.col("columns"), F.col("data"), language)


def term_batches(terms: DataFrame, size: int = 1000) -> DataFrame:
    """(batch, prompt): terms, spread by hash over about so many a batch, as prompts that ask for a label each."""
    n = F.greatest(F.lit(1), F.ceil(F.lit(terms.count()) / size)).cast("long")
    rows = terms.select(F.pmod(F.xxhash64("term"), n).alias("batch"), "term").groupBy("batch").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return rows.select("batch", "terms", F.concat(F.lit("Label each term translatable or untranslatable. Answer as a JSON object from term to label.\n"), F.to_json("terms")).alias("prompt"))


def labelled_terms(answers: DataFrame) -> DataFrame:
    """(term, label) of answered batches: a term without a proper label is unknown."""
    labels = F.from_json(T.strip_fence(F.col("answer")), "map<string,string>")
    rows = answers.withColumn("labels", labels).select("labels", F.explode("terms").alias("term"))
    label = F.try_element_at("labels", F.col("term"))
    return rows.select("term", F.when(label.isin("translatable", "untranslatable"), label).otherwise("unknown").alias("label"))


def question_prompt(n: int = 10) -> Column:
    table = F.to_json(F.struct("columns", "data"))
    return F.concat(F.lit(f"Write {n} questions on this table as a JSON array with question, answer, evidence_cells, question_type and reasoning_category, one of {', '.join(REASONING)}.\n"), table)


def generated_questions(answers: DataFrame) -> DataFrame:
    """Valid questions of (table_id, answer), numbered from 1 within their table."""
    kind = "array<struct<question:string,answer:array<array<string>>,evidence_cells:array<string>,question_type:string,reasoning_category:string>>"
    rows = worklists.question_ids(answers.withColumn("pairs", F.from_json(T.strip_fence(F.col("answer")), kind)))
    return worklists.valid_questions(rows.select("question_id", "table_id", "pair.*"))


def generate_questions(tables: DataFrame, client: Client, n: int = 10, tries: int = 3, at_once: int | None = None) -> DataFrame:
    """Valid questions on (table_id, columns, data). Tables whose call fails, or whose answer holds none that can be read, are asked again, up to `tries` times in all; an empty list is an answer.

    The answers of each try are kept in the shared folder, so none is asked for twice.
    """
    spark, left, rounds = tables.sparkSession, tables.select("table_id", "columns", "data"), []
    for _ in range(tries):
        path = scratch(spark, "questions")
        worklists.by_client(left.select("table_id", question_prompt(n).alias("prompt")), "prompt", client, at_once=at_once).drop("prompt").write.parquet(path)
        said = spark.read.parquet(path)
        rounds.append(said)
        empty = F.from_json(T.strip_fence(F.col("answer")), "array<string>")
        done = said.where(F.size(empty) == 0).select("table_id").unionByName(generated_questions(said).select("table_id")).distinct()
        left = left.join(done, "table_id", "left_anti")
        if left.isEmpty():
            break
    return generated_questions(reduce(DataFrame.unionByName, rounds))


def translated_questions(pairs: DataFrame, languages: list[str], client: Client) -> DataFrame:
    """Every question in every language: English passes through, and answers of type `value` stay as they are."""
    rows = worklists.by_language(pairs, languages)
    english, rest = rows.where("lang_code = 'en'"), rows.where("lang_code <> 'en'")
    said = worklists.by_client(rest.withColumn("prompt", F.concat(F.lit("Translate to "), "lang_code", F.lit(": "), "question")), "prompt", client, "said").drop("prompt")
    kept = F.when(F.col("question_type") == "value", F.col("answer")).otherwise(F.coalesce(F.from_json("said", "answer array<array<string>>")["answer"], F.col("answer")))
    new = said.where("said IS NOT NULL").withColumns({"question": F.coalesce(F.from_json("said", "question string")["question"], F.col("said")), "answer": kept}).drop("said")
    return english.unionByName(new)


def question_plan(questions: DataFrame, tables: DataFrame, done: DataFrame, languages: list[str]) -> DataFrame:
    """(table_id, lang_code, status): completed, pending, or failed where the questions' table is missing."""
    there = tables.select("table_id", F.lit(True).alias("there"))
    ready = done.select("table_id", "lang_code", F.lit(True).alias("ready")).distinct()
    rows = worklists.by_language(questions.select("table_id").distinct(), languages).join(there, "table_id", "left").join(ready, ["table_id", "lang_code"], "left")
    return rows.select("table_id", "lang_code", F.when(F.col("there").isNull(), "failed").when(F.col("ready"), "completed").otherwise("pending").alias("status"))


def run_statistics(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("rows"))
