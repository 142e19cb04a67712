"""A dictionary's terms in texts: the scan against plain string tests, and the join against the scan."""

import pickle
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.functions import cells as C
from tabweave.functions import terms as E
from tabweave.functions import text as T
from tabweave.operators import scoring
from tabweave.plans import catalogue

TEXTS = ["", None, "3.14 and 2..5, 1.2.3.4.5", "a+b = c^2", "Sin(x) cosine LOG maximum", "path/to/file_1.2.csv", "Neural Network layers", "İstanbul sin ΣΑΣ", "٣٫١ ١.٢.٣ ４２", "a/b/", "≤≥·Δ", "x" * 3000 + "gpt" + "/" + "9." * 50, "mincostmin min", "😀 token 😀/1 token"]


def plain_count(text: str) -> int:
    """Numbers, signs and names of functions, counted one by one."""
    return len(re.findall(r"\d+\.?\d*", text)) + sum(text.count(s) for s in T.OPERATORS + T.SYMBOLS) + sum(text.lower().count(f) for f in T.MATH_FUNCTIONS)


def plain_scan(text: str | None, terms: list) -> tuple:
    text = text or ""
    return plain_count(text), plain_count(text.split("/")[-1]), min((t for t in terms if t in text.lower()), default=None)


@pytest.mark.parametrize("terms", [[], C.UNTRANSLATABLE, ["sin", "min cost", "a", "٣", "İ", "tanbul", "😀", "UPPER", "9.9"]])
def test_scan(terms):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("sincotagmx lepr1.2/+-*😀é") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    got = E.Dictionary(terms).scan(pa.array(texts, pa.string())).to_pylist()
    assert [(x["universal"], x["last"], x["hit"]) for x in got] == [plain_scan(t, terms) for t in texts]
    assert len(E.Dictionary(terms).scan(pa.array([], pa.string()))) == 0


def test_dictionary_of_any_size(spark, monkeypatch):
    """By broadcast and by join the same: tables and cells with nulls, kinds, repeated rows, and terms shorter than a head."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    terms = sorted({word(r.randint(1, 9)) + r.choice(["", " x"]) for _ in range(300)} | {"q", "zz9"})
    known = spark.createDataFrame([(t, "untranslatable") for t in terms] + [("aaa", "translatable"), (None, "untranslatable"), ("", "untranslatable")], "term string, label string")
    cell = lambda: r.choice([None, "", "12", "g/h.csv", "qQ", "ZZ9!", " ".join("".join(r.choice("ghijkl") for _ in range(4)) for _ in range(5)), "GH" + word(8)])
    data = [[[cell() for _ in range(3)] for _ in range(r.randint(0, 6))] for _ in range(60)]
    rows = [(f"t{i}", "c", x[0] if x else [], x, [["text" if c else None for c in row] for row in x]) for i, x in enumerate(data)]
    tables = spark.createDataFrame(rows, "table_id string, category string, columns array<string>, data array<array<string>>, kinds array<array<string>>")
    for some in (tables, tables.drop("kinds")):
        cells = scoring.cells(some)
        each = [[sorted(map(tuple, f(x, known).collect()), key=str) for f, x in ((scoring.cell_translatability, cells), (scoring.table_translatability, some))]]
        monkeypatch.setattr(E, "MOST_TERMS", 20)
        each.append([sorted(map(tuple, f(x, known).collect()), key=str) for f, x in ((scoring.cell_translatability, cells), (scoring.table_translatability, some))])
        monkeypatch.undo()
        assert each[0] == each[1] and len(each[0][0]) == sum(len(row) for x in data for row in x)
        hits = sum(c is not None and not c.isdigit() and "/" not in c and any(t in c.lower() for t in terms) for x in data for row in x for c in row)
        assert sum(x[-1] == "untranslatable_label" for x in each[0][0]) == hits > 20


def test_learnt_terms_change_scores(spark):
    """A term that is learnt counts in the next score; one that is known keeps its label."""
    table = spark.createDataFrame([("t", "c", ["a"], [["Foobar 1"], ["plain words"], ["a strategy"]])], "table_id string, category string, columns array<string>, data array<array<string>>")
    known = scoring.dictionary(spark)
    learnt = scoring.learn_terms(known, spark.createDataFrame([("foobar", "untranslatable"), ("strategy", "untranslatable"), ("foobar", "untranslatable")], "term string, label string"))
    count = lambda terms: scoring.table_translatability(table, terms).first()["untranslatable_count"]
    assert (count(known), count(learnt)) == (0, 1) and learnt.count() == known.count() + 1
    tracked = {(r.label, r.term): r.occurrences for r in scoring.term_frequency(table, learnt).collect()}
    assert tracked == {("untranslatable", "foobar"): 1, ("unknown", "plain"): 1, ("unknown", "words"): 1, ("translatable", "strategy"): 1}


def test_tracking_of_terms(spark):
    """Short words aren't tracked, nor tables of one row; a cell's term of several words counts for each word that no dictionary has."""
    rows = [("t", "c", ["a"], [["ml of the neural network"], ["Neural network gpt"], ["7"], ["x/neural network"]]), ("one", "c", ["a"], [["alone"]])]
    tables = spark.createDataFrame(rows, "table_id string, category string, columns array<string>, data array<array<string>>")
    got = {(r.label, r.term): r.occurrences for r in scoring.term_frequency(tables).collect()}
    assert got == {("untranslatable", "neural network"): 5, ("untranslatable", "gpt"): 1}


def test_many_terms_take_little_more_time(spark):
    """Each batch is scanned once, whatever the number of terms: both dictionaries visit the text once, and the plan holds one scan."""
    cells = spark.range(1000).select(F.concat(F.lit("cell "), F.col("id").cast("string")).alias("cell"))
    many = spark.range(100_000).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
    out = E.with_found(cells, many, "cell")
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Exchange" not in plan
    assert out.where("found.hit IS NULL").count() == 1000


def test_a_batch_is_scanned_in_parts(monkeypatch):
    """What a scan holds follows a part of the batch; the parts give what the whole gives."""
    r = random.Random(5)
    texts = pa.array([None if r.random() < 0.1 else "".join(r.choices(["gpt", "é", "sin", "/", "1.5", "İ", "layer ", "x"], k=r.randrange(30))) for _ in range(300)] + ["y" * 500])
    some = E.Dictionary(["gpt", "layer", "é"])
    whole, seen, scan = some.scan(texts), [], E.Dictionary._scan
    monkeypatch.setattr(E, "MOST_SCANNED", 100)
    monkeypatch.setattr(E.Dictionary, "_scan", lambda self, part: seen.append([len((t or "").encode()) for t in part.to_pylist()]) or scan(self, part))
    assert some.scan(texts) == whole and len(some.scan(texts.slice(0, 0))) == 0
    assert len(seen) > 50 and max(sum(x[:-1]) for x in seen) <= 200


def test_a_dictionary_takes_little_memory():
    """A worker holds its terms and some bytes for each, not a tree of their characters; what goes to workers is the same arrays."""
    r = random.Random(2)
    terms = {"".join(r.choices("abcdefghijklmnop", k=r.randrange(6, 30))) for _ in range(50_000)}
    some = E.Dictionary(terms).terms
    held = [some.data, some.start, some.begun, *(x for head in some.heads.values() for x in head)]
    assert sum(x.nbytes for x in held) < sum(map(len, terms)) + 100 * len(terms)
    assert len(some) == sum(not any(t[:n] in terms for n in range(1, len(t))) for t in terms)  # none that begins with another
    assert len(pickle.dumps(some)) < sum(map(len, terms)) + 100 * len(terms)


def test_least_terms_of_shared_beginnings(monkeypatch):
    """Terms that begin with others, share eight bytes or more, or lie across the places looked up at once."""
    r = random.Random(3)
    for letters in ("ab", "aé😀", "xyz "):
        word = lambda n: "".join(r.choice(letters) for _ in range(n))  # noqa: B023, E731
        for most in (7, 64, 1 << 18):
            monkeypatch.setattr(E, "MOST_SCANNED", most)
            terms = [r.choice(["", "aaaaaaaa", "ab" * 9]) + word(r.randrange(1, 30)) for _ in range(200)]
            texts = [word(r.randrange(80)) + r.choice(terms)[: r.randrange(40)] + word(3) for _ in range(60)]
            assert E.Dictionary(terms).scan(pa.array(texts, pa.string())).field("hit").to_pylist() == [min((t for t in terms if t in x), default=None) for x in texts]


def test_learnt_scores_scan_once(spark, sf):
    """The filter on the number of cells needs no scan, so each task has one Python worker."""
    assert catalogue.QUERIES["learnt_term_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
