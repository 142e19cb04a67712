"""Tables recovered from printed words."""

import random

from tabweave.operators import print_tables

WORDS = "paper string, page int, x1 double, y1 double, x2 double, y2 double, text string"


def line(y: float, *texts, paper="p", page=1, height=10.0) -> list:
    """Words of texts given as (x, text): letters are five wide, spaces three."""
    out = []
    for x, text in texts:
        for word in text.split(" "):
            out.append((paper, page, float(x), float(y), x + 5.0 * len(word), y + height, word))
            x += 5 * len(word) + 3
    return out


def tables(spark, words) -> list:
    random.Random(2).shuffle(words)
    return sorted((r.paper, r.page, r.table_no, r.columns, r.data) for r in print_tables.grid_tables(spark.createDataFrame(words, WORDS), ["paper", "page"]).collect())


def test_grid(spark):
    """Prose above, between and below is no table; texts ranged right, of several words, missing and wide; a header's line breaks and empty places."""
    prose = "A line of prose that runs on and on"
    page = [
        *line(20, (50, prose)),
        *line(60, (50, "Model name"), (150, "Accuracy"), (250, "Seconds a run")),
        *line(72, (50, "small"), (170, "0.91"), (260, "7")),
        *line(84.4, (50, "very large model"), (170, "0.95")),
        *line(96, (60, "x"), (150, "spans both columns"), (290, "9")),
        *line(120, (50, prose)),
        *line(160, (50, "k"), (120, "v")), *line(172, (50, "1"), (120, "2")),
        *line(230, (50, "far"), (120, "below")), *line(242, (50, "3"), (120, "4 5")),
        *line(300, (50, "one line"), (120, "is no table")),
    ]
    other = [*line(60, (10, "a"), (80, "b"), page=2), *line(72, (10, "c"), (80, "d"), page=2), *line(60, (10, prose), paper="q"), ("q", 1, None, 1.0, 2.0, 3.0, "no box"), ("q", 1, 1.0, 1.0, 2.0, 3.0, None), ("q", 1, 1.0, 1.0, 2.0, 3.0, " ")]
    assert tables(spark, page + other) == [
        ("p", 1, 0, ["Model name", "Accuracy", "Seconds a run"], [["small", "0.91", "7"], ["very large model", "0.95", None], ["x", "spans both columns", "9"]]),
        ("p", 1, 1, ["k", "v"], [["1", "2"]]),
        ("p", 1, 2, ["far", "below"], [["3", "4 5"]]),
        ("p", 2, 0, ["a", "b"], [["c", "d"]]),
    ]


def test_random_grids(spark):
    """Any grid of any texts comes back, whatever order its words come in; words of a line may be a little higher or lower."""
    r = random.Random(5)
    words, want = [], []
    for page in range(40):
        n, k = r.randint(2, 8), r.randint(2, 6)
        grid = [[" ".join("".join(r.choice("abc123") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))) if r.random() < 0.85 or j == 0 or i == 0 else None for j in range(k)] for i in range(n)]
        grid = [row if sum(c is not None for c in row) > 1 else [c or "z" for c in row] for row in grid]
        for i, row in enumerate(grid):
            for j, cell in enumerate(row):
                if cell:
                    words += line(50 + 13 * i + r.uniform(-1, 1), (30 + 110 * j + r.uniform(0, 5), cell), page=page)
        want.append(("p", page, 0, grid[0], grid[1:]))
    assert tables(spark, words) == want
    assert tables(spark, [("p", 1, 0.0, 0.0, 1.0, 1.0, "alone")]) == []


def test_a_page_is_shuffled_once(spark):
    plan = print_tables.grid_tables(spark.createDataFrame(line(1, (1, "a")), WORDS), ["paper", "page"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(paper") == 1 and "Join" not in plan


def test_tasks_grow_with_the_words(spark, monkeypatch):
    """A task has some TASK_WORDS words at most, and captions don't compute the tables again."""
    monkeypatch.setattr(print_tables, "TASK_WORDS", 2)
    words = spark.range(40).selectExpr("id AS page", "0D AS x1", "0D AS y1", "9D AS x2", "9D AS y2", "'a' AS text")
    assert print_tables.spread(words, ["page"]).rdd.getNumPartitions() == 20
    blocks = spark.createDataFrame([], "page long, block int, x1 double, y1 double, x2 double, y2 double, text string")
    plan = print_tables.captioned(print_tables.grid_tables(words), blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count(" Sort ") < 12


def test_first_block_above_is_the_caption(spark):
    tables = spark.createDataFrame([(1, 0, 50.0, 100.0), (2, 0, 50.0, 100.0), (3, 0, 50.0, 100.0)], "page int, table_no int, x1 double, y1 double")
    blocks = [(1, 2, 50.0, 80.0, 90.0, 90.0, "Table 2"), (1, 1, 50.0, 60.0, 90.0, 70.0, "Table 1"), (1, 0, 50.0, 95.0, 90.0, 120.0, "Table 0"), (2, 0, 300.0, 80.0, 390.0, 90.0, "Table 3"), (2, None, 50.0, 80.0, 90.0, 90.0, "Table 4")]
    out = print_tables.captioned(tables, spark.createDataFrame(blocks, "page int, block int, x1 double, y1 double, x2 double, y2 double, text string"))
    assert {r.page: r.caption for r in out.collect()} == {1: "Table 1", 2: "", 3: ""}
