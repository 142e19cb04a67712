"""A file for each table, and lines that are seen at once, with tasks that fail."""

import json

import pytest
from pyspark.sql import functions as F

from tabweave.operators import evaluate, worklists
from tabweave.sources import files, readers


def failing(frame, at: int):
    """The rows, with a task that fails where id is `at`."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("id")[i].as_py() == at:
                    raise ValueError("half way")
                yield batch.slice(i, 1)

    return frame.mapInArrow(run, frame.schema)


def tables(spark, n=40):
    text = F.concat(F.lit("é/"), "id")
    return spark.range(0, n, 1, 4).select("id", F.concat(F.lit("t/"), "id").alias("table_id"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(F.array(text, F.lit(None).cast("string"))).alias("data"))


def test_a_file_for_each_table(spark, tmp_path):
    out = f"{tmp_path}/out"
    files.write_tables(tables(spark).drop("id"), out)
    assert json.loads((tmp_path / "out/t_7.json").read_text()) == {"columns": ["a", "b"], "data": [["é/7", None]]}
    got = readers.tables(spark, out, pattern="t_*.json").collect()
    assert sorted(r.table_id for r in got) == sorted(f"t_{i}" for i in range(40)) and not any(r.malformed for r in got)
    about = json.loads((tmp_path / "out/_written.json").read_text())
    assert (about["files"], about["rows"]) == (40, 40) and not list((tmp_path / "out").glob("_tasks*"))
    files.write_tables(tables(spark, 3).drop("id"), f"file://{out}", indent=0)
    assert len(list((tmp_path / "out").glob("t_*.json"))) == 40
    files.write_tables(tables(spark, 0).drop("id"), f"{tmp_path}/none")
    assert json.loads((tmp_path / "none/_written.json").read_text())["rows"] == 0


def test_of_a_task_that_fails_no_file_is_seen(spark, tmp_path):
    """One task of four fails after half its rows: the files of others may be there (a task may be stopped while it moves them), whole; its own aren't."""
    with pytest.raises(Exception, match="half way"):
        files.write_tables(failing(tables(spark), 25), f"{tmp_path}/out")
    there = {int(p.stem[2:]) for p in (tmp_path / "out").glob("t_*.json")}
    assert not there & set(range(20, 30)) and not (tmp_path / "out/_written.json").exists()
    assert all(json.loads((tmp_path / f"out/t_{i}.json").read_text())["data"] == [[f"é/{i}", None]] for i in there)
    files.write_tables(tables(spark), f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("t_*.json"))) == 40


def questions(spark):
    return spark.range(0, 40, 1, 4).select("id", F.concat(F.lit("q"), "id").alias("question_id"), F.lit("en_clean.jpg").alias("image_filename"), F.lit("x\ny").alias("model_response"))


def test_lines(spark, tmp_path):
    """Lines are whole, and the next run adds what is left."""
    rows, out = questions(spark), f"{tmp_path}/out"
    with pytest.raises(Exception, match="half way"):
        files.append_lines(failing(rows, 27), out, flush=3)
    assert not any(int(json.loads(x)["question_id"][1:]) in range(26, 30) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines())
    files.append_lines(rows.where("id < 12"), out, flush=3)
    done = readers.completed(readers.json_lines(spark, f"{out}/*.json"))
    files.append_lines(evaluate.remaining(rows, done), out)
    lines = readers.json_lines(spark, f"{out}/*.json")
    assert lines.where("NOT parsed").count() == 0 and {int(r.question_id[1:]) for r in readers.responses(lines).collect()} == set(range(40))


def test_answers_of_a_lost_task_are_kept(spark, tmp_path):
    """A worker that dies at its eighth call leaves seven answers; the next run asks for the others alone."""
    rows, out = questions(spark).drop("model_response").withColumn("prompt", F.col("question_id")), f"{tmp_path}/out"

    def client(fatal):
        def make():
            def call(text):
                if text == fatal:
                    raise SystemExit
                return f"answer to {text}"

            return call

        return make

    with pytest.raises(Exception, match=""):
        worklists.by_client(rows, "prompt", client("q27"), "model_response", kept_in=out).write.format("noop").mode("overwrite").save()
    done = readers.completed(readers.json_lines(spark, f"{out}/*.json"))
    first = {int(r.question_id[1:]) for r in done.collect()}
    assert first & set(range(20, 30)) == set(range(20, 27))
    left = evaluate.remaining(rows, done)
    assert {r.id for r in left.collect()} == set(range(40)) - first
    worklists.by_client(left, "prompt", client(""), "model_response", kept_in=out).write.format("noop").mode("overwrite").save()
    lines = readers.responses(readers.json_lines(spark, f"{out}/*.json")).collect()
    assert sorted((int(r.question_id[1:]), r.model_response) for r in lines) == [(i, f"answer to q{i}") for i in range(40)]
