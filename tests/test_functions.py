"""Edge cases of column functions and operators on small inline rows."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import answers
from tabweave.functions import cells as C
from tabweave.functions import metrics as M
from tabweave.functions import text as T
from tabweave.operators import collect, evaluate, scoring, stats, translate, worklists
from tabweave.schema import QUESTION_TYPES, REASONING
from tabweave.sources import readers, search, writers
from tabweave.streaming import incremental


def value(spark, column, text=None):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("cell", "score", "reason"),
    [
        ("12", 1.0, "numeric_universal"),
        ("1.0", 1.0, "numeric_universal"),
        ("N/A", 0.85, "file_path_with_content"),
        ("24/7", 0.95, "file_path_mostly_universal"),
        ("a.csv", 0.85, "file_path_with_content"),
        ("Player of the organization", 0.0, "untranslatable_label"),
        ("", 1.0, "mostly_universal"),
        ("3 + 4 = 7", 1.0, "mostly_universal"),
        ("plain words", 0.9, "translatable_text"),
        (None, 1.0, "non_string_universal"),
    ],
)
def test_translatability(spark, cell, score, reason):
    assert tuple(value(spark, C.translatability(F.col("t")), cell)) == (score, reason)


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ('[["Row 5"]]', "5"), ('[["Item 5"]]', "item 5"), ('[["$1,234"]]', "1234"), ('[["2.50"]]', "2.5"), ('[["time: 5"]]', "5"), ('[["1-2"]]', "1-2"),
        ('{"data": [["5"]]}', "5"), ("abc é 12", "12 abc"), (None, "none"), ("3.0", "3"), ('[1, [2.5, "X"]]', "1 2.5 x"), ('{"a": "Yes", "b": 2}', "yes 2"), ('[["٣"]]', "3"), ('[["\\"q: x\\", {7}"], true, null, -0, 1.50, 1e3]', '7 true none 0 1.5 1000'),
        ('{"b": 1, "a": {"k:": "v"}, "data": {"z": [3], "y": 2}}', "3 2"), ('{"data": "Total: 1,000"}', "1000"), ('{"data": null}', "none"), ('{"data": [1.25]}', "1.25"), ("7 x_1 007 é2 Zz", "7 7 zz"), ("[1] 2", "1 2"), ("[1][2 a]", "1 2 a"), ('{"a": 1}} b', "1 a b"), ("-5 pears", "5 pears"), (" [[1], {\"]\": 2}] ", "1 2"), ("", ""), ("[]", ""), ('["e", "-", "1e", "1.2.3"]', "e - 1e 1.2.3"),
    ],
)
def test_answer_text(spark, raw, text):
    assert value(spark, answers.answer_text(F.col("t")), raw) == text


def test_numbers_of_answers(spark):
    """Numbers are written as Python writes them: texts to six places, JSON numbers as they are."""
    r = random.Random(8)
    numbers = [0.1, 1e-5, 2.5e-7, 123456789.125, 1e15 + 0.5, 0.30000000000000004, 1 / 3, -7.25, 12.5e10, 99999.9999999, 0.0000005, 1.25e-300, -0.0000001, 4.35, 1e22] + [r.uniform(-1, 1) * 10 ** r.randint(-8, 12) for _ in range(2000)]
    rows = spark.createDataFrame([(json.dumps([n]), json.dumps([repr(n)]), i) for i, n in enumerate(numbers)], "number string, text string, i int")
    got = rows.select("i", answers.answer_text(F.col("number")).alias("number"), answers.answer_text(F.col("text")).alias("text")).orderBy("i").collect()
    plain = lambda n: str(int(n)) if n.is_integer() else str(n)
    assert [(x.number, x.text) for x in got] == [(plain(n), str(int(n)) if n.is_integer() else str(round(n, 6))) for n in numbers]


def test_scores():
    words = lambda *texts: [t.split() for t in texts]
    assert M.f1(words("", "", "a b"), words("", "x", "b c")).tolist() == [1, 0, 0.5]
    got = M.adaptive_bleu_of(words("", "a b c", "a b c d", "a x"), words("x", "a b c", "a b c d", "a b c"))
    assert got == pytest.approx([0, 1, 1, math.exp(1 - 3 / 2) / 2])
    table = ["h1", "h2", "1", "2", "3", "4"]
    assert M.bleu([table, []], [table, table], (4,))[0].tolist() == [1.0, 0.0]
    assert len(M.f1([], [])) == 0 and M.bleu([], [], (1, 4)).shape == (2, 0)


def plain_bleu(a: list, b: list, orders: int) -> float:
    """One pair, with counters."""
    total = 0.0
    for n in range(1, orders + 1):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        m = (x & y).total()
        if not a or n == 1 and not m:
            return 0.0
        total += math.log((m or 0.1) / max(1, len(a) - n + 1)) / orders
    return math.exp(total) * (1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a)))


def test_scores_of_batches():
    r = random.Random(2)
    some = [([r.choice("abcde") for _ in range(r.randint(0, 14))], [r.choice("abcdef") for _ in range(r.randint(0, 14))]) for _ in range(800)]
    got = M.bleu(*zip(*some, strict=True), (1, 2, 4))
    assert got.T == pytest.approx(np.array([[plain_bleu(a, b, n) for n in (1, 2, 4)] for a, b in some]))
    assert M.f1(*zip(*some, strict=True)) == pytest.approx([float(a == b) if not a or not b else 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) for a, b in some])


def test_printed_means(spark, tmp_path):
    """As C and Python print them: exact ties go to the even digit, other halves by the binary value."""
    r = random.Random(1)
    numbers = [8.625, 8.375, 2.675, 0.0, 0.005, 0.125, 9.995, 1.005, 0.5, 1.5, 2.5, 4194304.005, 2047.995, 1e9 + 0.5, 5e-324] + [r.randint(0, 5000) / r.randint(1, 400) for _ in range(3000)] + [10 ** r.uniform(-6, 9.8) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    for places in (0, 1, 2, 4):
        assert [x.s for x in rows.select("x", T.printed(F.col("x"), places).alias("s")).collect()] == [f"{x:.{places}f}" for x in numbers]
    selected = spark.createDataFrame([("b", 8 + (k < 5), 5 + k % 2, 2, k < 3) for k in range(8)] + [("a", 10, 7, 3, True)], "category string, score int, num_rows long, num_columns long, has_metadata boolean")
    writers.csv_summary(scoring.csv_summary(selected), f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["Category,Tables,Min Score,Max Score,Avg Score,Avg Rows,Avg Cols,Score 10,Score 9,Score 8,Metadata Files", "a,1,10,10,10.00,7,3,1,0,0,1", "b,8,8,9,8.62,6,2,0,5,3,3"]


def test_missing_and_gates(spark):
    rows = spark.createDataFrame([(1, [["a", None]]), (2, [["NaN"]]), (3, [[""]]), (4, None), (5, [[]])], "i int, data array<array<string>>")
    assert [r.i for r in rows.where(C.has_missing(F.col("data"))).orderBy("i").collect()] == [1, 2]
    nulls = [[None] * 3, [None] * 3, [None, None, "x"]]
    gate = spark.createDataFrame([(["a", "b", "c"], nulls), (["a", "b", "c"], [["1", "2", "3"]] * 3), (["a"], [["1"]])], "columns array<string>, data array<array<string>>")
    assert [r[0] for r in gate.select(C.quality_gate(F.col("columns"), F.col("data"))).collect()] == [False, True, False]
    host = spark.createDataFrame([(["Unnamed: 0", "Unnamed: 1", "c"], [["1", "2", "3"]] * 2), (["a", "b"], [["1", "2"]] * 2)], "columns array<string>, data array<array<string>>")
    assert [r[0] for r in host.select(C.code_host_gate(F.col("columns"), F.col("data"))).collect()] == [False, True]


def test_column_types(spark):
    """By the least type that all cells have; short rows, nulls, signs, large numbers, names that repeat, no columns and no rows."""
    rows = [
        ("a", ["n", "x", "t", "n", None], [["1", "1.5", "True", "-2"], ["+7", "2", "False", "3", None]]),
        ("b", ["n", "x", "t", "big"], [["1", "nan", "True", "99999999999999999999"], [None, "1e3", None, "1"]]),
        ("c", ["n", "x"], [["1 ", "a"], ["2", ""]]), ("d", ["n"], []), ("e", [], [[]]),
    ]
    tables = spark.createDataFrame(rows, "table_id string, columns array<string>, data array<array<string>>")
    got = {r.table_id: r for r in collect.table_statistics(tables).collect()}
    assert got["a"].data_types == {"n": "int64", "x": "float64", "t": "bool", "": "float64"} and got["a"].column_names == ["n", "x", "t", "n", None]
    assert (got["a"].num_rows, got["a"].num_cells, got["a"].numeric_columns, got["a"].text_columns, got["a"].numeric_share) == (2, 10, 4, 0, 0.8)
    assert got["b"].data_types == {"n": "float64", "x": "float64", "t": "object", "big": "float64"}
    assert got["c"].data_types["x"] == "object" and got["d"].data_types == {"n": "object"} and got["e"].data_types == {} and got["e"].numeric_share == 0


def test_counters_while_writing(spark, tmp_path):
    """One pass: a single scan and no aggregate of its own; the counters are those of the query."""
    rows = spark.createDataFrame([("t%d" % i, "s%d" % (i % 2), ["a"] * (1 + i % 4), [["1", None, "3"]] * (i % 5)) for i in range(60)], "table_id string, source string, columns array<string>, data array<array<string>>")
    gated = collect.gated(rows)
    tables, observation = collect.counted(gated, ["s0", "s1", "none"])
    out = tables.where("accepted")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Aggregate" not in plan
    out.write.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, collect.observed_counters(observation, spark).collect())) == sorted(map(tuple, collect.counters(gated).collect()))


def test_names(spark):
    assert value(spark, stats.hash_of(F.lit("github_csv_ab12.json"))) == "csv_ab12"
    assert value(spark, stats.source_of(F.lit("github_csv_ab12.json"))) == "other"
    assert value(spark, stats.category_of(F.lit("GitHub_x.json"), ["arxiv", "github"])) == "github"
    for name, language in {"id_casual_noise2.jpg": "id_casual", "id_formal_clean.jpg": "id_formal", "nan_spoken_clean.jpg": "unknown", "en_art_deco_clean.jpg": "unknown", "": "unknown"}.items():
        assert value(spark, evaluate.image_language(F.lit(name))) == language
    assert value(spark, worklists.table_of(F.lit("arxiv_ab_001"))) == "arxiv_ab"
    assert [value(spark, C.coordinate_column(F.lit(x))) for x in ("A1", "Z3", "AA1")] == [0, 25, 26]
    assert value(spark, T.response_answer(F.lit('<think>x</think>{"data":[["1"]]}'))) == [["1"]]
    assert value(spark, T.response_answer(F.lit("no json"))) == [["no json"]]
    assert [value(spark, worklists.nested_answer(F.lit(x))) for x in ("5", '["a", "b"]', '[["a"], ["b"]]')] == [[["5"]], [["a", "b"]], [["a"], ["b"]]]


def test_medians_and_modes(spark):
    rows = spark.createDataFrame([("s", x) for x in (3, 1, 3, 1, 9)] + [("t", x) for x in (1, 2, 3, 4)], "source string, chars long")
    got = {r.source: r for r in stats.char_stats_by_source(rows).collect()}
    assert got["s"].mode_characters_per_file == 1 and got["t"].median_characters_per_file == 2.5
    assert rows.where("source = 't'").select(scoring.upper_median("chars")).first()[0] == 3
    decided = stats.with_threshold(rows)
    assert decided.where("source = 's' AND decision = 'kept'").count() == 3  # equal to the median is kept


def test_small_tables_score_one(spark):
    rows = spark.createDataFrame([("a", "c", ["h"], [["x y", "z"]]), ("b", "c", ["h"], [["plain"], ["words"]])], "table_id string, category string, columns array<string>, data array<array<string>>")
    scores = {r.table_id: r.score for r in scoring.table_scores(scoring.table_translatability(rows)).collect()}
    assert scores == {"a": 1, "b": 10}


def test_evidence(spark):
    table = [["2022", "Alpha", "150"], ["2022", "Beta", "200"], ["2023", "Alpha", "180"], ["2023", "Beta", "190"]]
    tables = spark.createDataFrame([("t", "c", ["Year", "Product", "Revenue"], table)], "table_id string, category string, columns array<string>, data array<array<string>>")
    pairs = spark.createDataFrame([("t_001", "t", ["C3", "C4"])], "question_id string, table_id string, evidence_cells array<string>")
    assert sum(int(r.cell) for r in worklists.evidence(pairs, scoring.cells(tables)).collect()) == 370


def test_questions(spark):
    pairs = spark.createDataFrame([("q", [["1"]], "value", "Multi-Hop Reasoning"), ("q", [["1"]], "value", "Multi-hop Reasoning"), ("q", [], "value", "Outlier Detection")], "question string, answer array<array<string>>, question_type string, reasoning_category string")
    assert worklists.valid_questions(pairs).count() == 1


def test_html(spark):
    page = "<figure><figcaption>Fig 1</figcaption><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2 &amp; 3</td></tr></table></figure><table><caption>Own</caption><tr><td>only</td></tr></table>"
    rows = collect.html_tables(spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")).collect()
    assert [(r.id, r.caption, r["columns"], r.data) for r in rows] == [(1, "Fig 1", ["a", "b"], [["1", "2 & 3"]]), (1, "Own", ["0"], [["only"]])]


def test_csv(spark):
    rows = collect.sniff_csv(spark.createDataFrame([("a;b\n1;2\n1;2;3\n",), ("alone\n",), (None,)], "content string")).collect()
    assert (rows[0].delimiter, rows[0]["columns"], rows[0].data) == (";", ["a", "b"], [["1", "2"]]) and rows[1].delimiter is None and rows[2].delimiter is None


def test_model_calls(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, prompt string")
    assert [r.answer for r in worklists.by_client(rows, "prompt", worklists.echo_client).orderBy("id").collect()] == ["x", None]

    def failing():
        def call(text):
            raise RuntimeError

        return call

    assert worklists.by_client(rows, "prompt", failing).where("answer IS NOT NULL").count() == 0


def test_table_files(spark, tmp_path):
    (tmp_path / "arxiv_a.json").write_text('{"columns": ["a", "b"],\n "data": [[NaN, 1.50], ["NaN", 1e-7]]}')
    (tmp_path / "bad.json").write_text('{"columns": [')
    (tmp_path / "no_data.json").write_text('{"columns": []}')
    rows = {r.table_id: r for r in readers.tables(spark, str(tmp_path)).collect()}
    assert rows["arxiv_a"].data == [["NaN", "1.5"], ["NaN", "1.0E-7"]] and rows["bad"].malformed and rows["no_data"].data is None
    assert rows["arxiv_a"].kinds == [["number", "number"], ["text", "number"]] and not rows["arxiv_a"].malformed
    writers.tables(readers.tables(spark, str(tmp_path)).select("table_id", "columns", "data"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_line_files(spark, tmp_path):
    lines = ['{"question_id": "q1", "language": "en", "answer": [["1"]]}', "", "not json", '{"question_id": "q1", "language": "en", "answer": [["2"]]}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    raw = readers.json_lines(spark, str(tmp_path / "d.jsonl"))
    assert raw.count() == 3 and raw.where("NOT parsed").count() == 1
    kept = evaluate.last_wins(readers.dataset(raw).select("question_id", "language", "golden_answer", "line_no"), ["question_id", "language"], "line_no").collect()
    assert len(kept) == 1 and json.loads(kept[0].golden_answer) == [["2"]]
    said = [{"question_id": "q1", "image_filename": "en_clean.jpg", "model_response": [["2"]]}, {"question_id": "q1", "image_filename": "en_clean.jpg", "model_response": "CUDA out of memory"}, {"question_id": "q1", "image_filename": "xx_clean.jpg", "model_response": "2"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, said)) + "\nbroken")
    tagged = evaluate.tag(readers.responses(readers.json_lines(spark, str(tmp_path / "r.jsonl"))), readers.dataset(raw))
    assert sorted(r.outcome for r in tagged.collect()) == ["no_match", "parse_error", "processed", "skipped"]
    assert [r.exact_match for r in evaluate.score(tagged).collect()] == [1]
    assert readers.completed(readers.json_lines(spark, str(tmp_path / "r.jsonl"))).count() == 2


def test_images_and_scores(spark, tmp_path):
    for name in ("t1/clean/en_clean.jpg", "t1/noise/en_noise1.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert {tuple(r) for r in readers.image_catalogue(spark, str(tmp_path)).collect()} == {("t1", "clean", "en_clean.jpg"), ("t1", "noise", "en_noise1.jpg")}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/arxiv_table_scores.json").write_text('{"category": "arxiv", "tables": [{"file": "a.json", "score": 7}]}')
    assert [tuple(r) for r in readers.scores(spark, str(tmp_path / "s"), ["ARXIV"]).collect()] == [("arxiv", "a.json", 7)]


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: incremental.run_available(spark, str(tmp_path / "in"), "a int", lambda df: df.withColumn("b", F.col("a") + 1), str(tmp_path / "out"), str(tmp_path / "state"))
    (tmp_path / "in/1.json").write_text('{"a": 1}')
    run()
    (tmp_path / "in/2.json").write_text('{"a": 2}')
    run()
    run()
    assert sorted(r.b for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]



def test_search_source(spark):
    spark.dataSource.register(search.SearchSource)
    rows = spark.read.format("paged_search").option("terms", "a,b").option("client", "tests.clients:find").load()
    hits = readers.search_hits(rows.withColumn("host", F.lit("h")))
    assert sorted(r.path for r in hits.collect()) == ["a1.csv", "b1.csv"]


def test_patient_and_rotating_clients():
    calls = []

    def flaky():
        def call(text):
            calls.append(text)
            if len(calls) < 3:
                raise ValueError
            return text

        return call

    assert translate.patient(flaky, attempts=3, wait=0)()("x") == "x" and len(calls) == 3

    def broken():
        def call(text):
            raise ValueError

        return call

    assert translate.rotating([broken, worklists.echo_client])()("y") == "y"
    with pytest.raises(ValueError):
        translate.patient(broken, attempts=2, wait=0)()("x")


def test_terms_and_questions(spark):
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    batches = translate.term_batches(terms)
    answers = batches.withColumn("answer", F.lit('```json\n{"a": "translatable", "b": "nonsense"}\n```'))
    assert {tuple(r) for r in translate.labelled_terms(answers).collect()} == {("a", "translatable"), ("b", "unknown"), ("c", "unknown")}
    said = json.dumps([{"question": "q", "answer": [["1"]], "evidence_cells": ["A1"], "question_type": "value", "reasoning_category": "Outlier Detection"}, {"question": "q"}])
    pairs = translate.generated_questions(spark.createDataFrame([("t", said), ("u", "broken")], "table_id string, answer string"))
    assert [r.question_id for r in pairs.collect()] == ["t_001"]
    out = {r.lang_code: r for r in translate.translated_questions(pairs, ["en", "fr"], worklists.echo_client).collect()}
    assert out["en"].question == "q" and out["fr"].question == "Translate to fr: q" and out["fr"].answer == [["1"]]


def test_questions_are_asked_for_again(spark, tmp_path):
    """A failed call, an unreadable answer and one without a valid question are tried again, three times at most; an empty list isn't."""
    tables = spark.createDataFrame([(t, [t], [["1"]]) for t in "abcd"], "table_id string, columns array<string>, data array<array<string>>")
    good = json.dumps([{"question": "q?", "answer": [["1"]], "evidence_cells": ["A2"], "question_type": QUESTION_TYPES[0], "reasoning_category": REASONING[0]}])

    def client():
        def call(prompt):
            name = json.loads(prompt.split("\n", 1)[1])["columns"][0]
            with open(f"{tmp_path}/{name}", "a") as f:
                f.write("x")
            n = (tmp_path / name).stat().st_size
            if name == "a" and n < 3:
                raise ConnectionError
            return {"a": good, "b": "no JSON" if n < 2 else f"```json\n{good}\n```", "c": "[]", "d": json.dumps([{"question": "no answer"}])}[name]

        return call

    got = translate.generate_questions(tables, client, at_once=1).collect()
    assert sorted(r.question_id for r in got) == ["a_001", "b_001"]
    assert {p.name: p.stat().st_size for p in tmp_path.iterdir() if len(p.name) == 1} == {"a": 3, "b": 2, "c": 1, "d": 3}


def test_evaluation_files(spark, tmp_path):
    tagged = spark.createDataFrame([("q1", "en", "[[5]]", "[[5]]", "processed", "m"), ("q2", "fr", "a b", "a c", "processed", "m"), ("q3", "fr", "CUDA out of memory", "x", "skipped", "m")], "question_id string, language string, model_response string, golden_answer string, outcome string, model_name string")
    scored = evaluate.score(tagged)
    writers.evaluation(scored, evaluate.counters(tagged), evaluate.overall(scored), evaluate.per_language(scored), str(tmp_path), "data.jsonl", "out.jsonl", "m")
    about = json.loads((tmp_path / "summary_out.json").read_text())
    assert about["metadata"] == {"model_name": "m", "dataset_file": "data.jsonl", "response_file": "out.jsonl", "total_samples": 2}
    assert about["overall_metrics"]["exact_match"] == 0.5 and about["overall_metrics"]["cuda_errors"] == 1 and list(about["per_language_metrics"]) == ["en", "fr"]
    lines = [json.loads(x) for p in (tmp_path / "metrics_out.jsonl").glob("*.json") if p.name[0] != "_" for x in p.read_text().splitlines()]
    assert sorted((x["question_id"], x["f1_score"]) for x in lines) == [("q1", 1.0), ("q2", 0.5)]


def test_translation_steps(spark):
    tables = spark.createDataFrame([("t", ["a"], [["1"], ["2"]]), ("u", ["b"], [["3"], [None]])], "table_id string, columns array<string>, data array<array<string>>")
    work = worklists.by_language(tables, ["fr"])
    none = work.limit(0)

    def answer():
        return lambda prompt: prompt.partition("\n")[2] if '"a"' in prompt else "no table"

    first = translate.step(work, none, translate.table_prompt(F.col("lang_code")), answer)
    assert [r.table_id for r in first.collect()] == ["t"]
    assert [(r.bleu_score, r.decision) for r in translate.quality(tables, first).collect()] == [(pytest.approx(plain_bleu(["a", "1", "2"], ["a", "1", "2"], 4)), "KEEP")]


def test_located_and_first_tables(spark):
    html = spark.createDataFrame([("p1", 1)], "paper string, t int")
    pdf = spark.createDataFrame([("p1", 2), ("p2", 3)], "paper string, t int")
    assert sorted(r.t for r in collect.first_tables(html, pdf).collect()) == [1, 3]
    assert value(spark, collect.clean_headers(F.array(F.lit(" a\nb "), F.lit(None).cast("string")))) == ["a b", ""]
    assert collect.query_text(["x", "y"], (1, 9)) == "(x OR y) extension:csv size:1..9"


def test_typed_cells_score(spark):
    rows = spark.createDataFrame([("t", "[[1.5, true], [0.25, null], [{}, \"a b\"]]")], "table_id string, j string")
    data, kinds = C.typed(F.from_json("j", "array<array<variant>>"))
    table = rows.select("table_id", F.lit("c").alias("category"), F.array().cast("array<string>").alias("columns"), data.alias("data"), kinds.alias("kinds"))
    got = [(r.score, r.reason) for r in scoring.cell_translatability(scoring.cells(table)).orderBy("row_idx", "col_idx").collect()]
    assert got == [(1.0, "numeric_universal")] * 3 + [(1.0, "non_string_universal")] * 2 + [(0.9, "translatable_text")]
    assert scoring.distinct_terms(table.withColumn("data", F.array(F.array(F.lit("alpha"), F.lit("beta")))).withColumn("kinds", F.array(F.array(F.lit("other"), F.lit("text"))))).collect()[0].term == "beta"


def test_csv_quotes(spark):
    text = 'name,n,\r\n"Doe, J",1,"say ""x""\nmore"\na,b,c,d\nshort\n'
    row = collect.sniff_csv(spark.createDataFrame([(text,), (None,), ("one column",)], "content string")).collect()
    assert (row[0].delimiter, row[0]["columns"], row[0].data) == (",", ["name", "n", "Unnamed: 2"], [["Doe, J", "1", 'say "x"\nmore'], ["short", None, None]])
    assert row[1].data is None and row[2].delimiter is None and row[2].data is None


def test_response_fallback(spark):
    said = ["<think>why</think> plain words", '<think>a</think>{"data": [["1"]]}', '{"data": [["2"]]}', "no json", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(T.response_answer(F.col("s"))).collect()]
    assert got == [[[said[0]]], [["1"]], [["2"]], [["no json"]], [[None]]]


def test_evaluation_end_to_end(spark):
    """The joined evaluation by hand: outcomes, metrics, means and the first model's name."""
    gold = spark.createDataFrame([("q1", "en", '[["12", "Apples"]]', 1), ("q1", "en", '[["12", "pears"]]', 2), ("q2", "fr", '[["x"]]', 3)], "question_id string, language string, golden_answer string, line_no int")
    said = spark.createDataFrame(
        [("q1", "en_clean.jpg", '{"data": [["12", "Pears"]]}', True, 5, "m/b"), ("q2", "fr_noise1.jpg", '[["y"]]', True, 4, None), ("q2", "fr_clean.jpg", "CUDA out of memory", True, 6, "m/a"), ("q9", "en_clean.jpg", "x", True, 7, "m"), (None, None, None, False, 8, None)],
        "question_id string, image_filename string, model_response string, parsed boolean, line_no int, model_name string",
    )
    tagged = evaluate.tag(said, gold)
    scored = evaluate.score(tagged)
    rows = {r.question_id: r for r in scored.collect()}
    assert rows["q1"].model_str_normalized == rows["q1"].gold_str_normalized == "12 pears"
    assert (rows["q1"].exact_match, rows["q1"].f1_score, rows["q2"].exact_match, rows["q2"].f1_score) == (1, 1.0, 0, 0.0)
    made = json.loads(evaluate.summary(tagged, scored).first().summary)
    assert made["model_name"] == "m/b" and made["metadata"]["total_responses"] == 5 and made["overall_metrics"]["samples"] == 2 and made["overall_metrics"]["exact_match"] == 0.5
    assert [x["language"] for x in made["per_language_metrics"]] == ["en", "fr"]


def test_orders_and_lists(spark, tmp_path):
    decided = stats.with_threshold(spark.createDataFrame([("a", "s", 1), ("b", "s", 5), ("c", "s", 9)], "table_id string, source string, chars long"))
    assert [r.table_id for r in stats.in_order(decided, "kept").collect()] == ["c", "b"]
    reviews = spark.createDataFrame([("finqa_1_001",), ("arxiv_2_001",), ("finqa_3_001",)], "question_id string")
    assert [r.dataset for r in worklists.datasets(reviews).collect()] == ["arxiv", "finqa"]
    tables = spark.createDataFrame([("finqa_1", ["h"], [["x"]])], "table_id string, columns array<string>, data array<array<string>>")
    assert sorted((r.question_id, r.data) for r in worklists.with_table(reviews, tables).collect() if r.data) == [("finqa_1_001", [["x"]])]
    assert writers.tables(tables, str(tmp_path / "none"), dry_run=True).first()["count"] == 1 and not (tmp_path / "none").exists()
    writers.with_metadata(tables, str(tmp_path / "kept"), spark.createDataFrame([("finqa_1", 1), ("other", 2)], "table_id string, x int"))
    assert spark.read.json(str(tmp_path / "kept/metadata")).count() == 1
    (tmp_path / "dump.json").write_text('{"table": {"header": ["a"], "rows": [["1"]], "page_title": "P"}}')
    assert [tuple(r) for r in readers.wiki_tables(spark, str(tmp_path / "dump.json")).collect()] == [("P", ["a"], [["1"]])]
    (tmp_path / "c_table_scores.json").write_text('{"tables": [{"file": "t", "score": 3}, {"file": "t", "score": 8}]}')
    assert [tuple(r) for r in readers.scores(spark, str(tmp_path)).collect()] == [("c", "t", 8)]
