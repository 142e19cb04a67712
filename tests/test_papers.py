"""Tables of papers from pages, else from prints, with addresses that fail."""

import json

from tabweave.operators import papers


def words(page, y, *texts):
    return [{"page": page, "x1": x, "y1": y, "x2": x + 5.0 * len(t), "y2": y + 10, "text": t} for x, t in texts]


def test_print_where_the_page_has_none(spark, tmp_path):
    table = "<table><caption>On page</caption><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    grid = words(1, 100.0, (50.0, "h"), (120.0, "k")) + words(1, 112.0, (50.0, "1"), (120.0, "2"))
    late = words(2, 50.0, (50.0, "x"), (120.0, "y")) + words(2, 62.0, (50.0, "3"), (120.0, "4"))
    block = {"page": 1, "block": 0, "x1": 50.0, "y1": 80.0, "x2": 200.0, "y2": 92.0, "text": "Table 1: printed"}
    pages = {"p/a": table, "p/b": "<p>no table</p>", "p/d": "<p>none</p>"}
    prints = {"q/a": {"words": grid}, "q/b": {"words": late + grid, "blocks": [block]}, "q/c": {"words": grid}}

    def client(answers, log, text=lambda x: x):
        def make():
            def call(address):
                with open(f"{tmp_path}/{log}", "a") as f:
                    f.write(f"{address} ")
                return text(answers[address])  # a KeyError where there is none

            return call

        return make

    rows = spark.createDataFrame([("a", "p/a", "q/a"), ("b", "p/b", "q/b"), ("c", "p/gone", "q/c"), ("d", "p/d", "q/gone"), ("e", None, None)], "paper string, page_url string, print_url string")
    got = sorted(map(tuple, papers.tables(rows, client(pages, "pages"), client(prints, "prints", json.dumps), at_once=1).collect()))
    assert got == [
        ("a", "page", 0, "On page", ["a"], [["1"]]),
        ("b", "print", 0, "Table 1: printed", ["h", "k"], [["1", "2"]]),
        ("b", "print", 1, "", ["x", "y"], [["3", "4"]]),
        ("c", "print", 0, "", ["h", "k"], [["1", "2"]]),
    ]
    assert sorted((tmp_path / "pages").read_text().split()) == ["p/a", "p/b", "p/d", "p/gone"]
    assert sorted((tmp_path / "prints").read_text().split()) == ["q/b", "q/c", "q/gone"]
    assert papers.tables(rows.limit(0), client(pages, "x"), client(prints, "x")).count() == 0
