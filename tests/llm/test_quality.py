"""Naive Bayes support vectors: n-grams, ratios and descent against plain forms, and accuracy on held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.llm import quality

SCHEMA = "doc_id long, text string, good int, held string, grams string, id int, label string, quality string"
SPACE = r"[\x20\x09-\x0D]+"


def word_class(word: str, before: str | None) -> tuple:
    data = word.encode()
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    case = 0 if upper + lower == 0 else 1 if upper == 0 else 2 if upper == 1 and 65 <= data[0] <= 90 else 3 if lower == 0 else 4
    punctuation = lambda c: c < 128 and not chr(c).isalnum()
    ends = []
    for c in data[::-1][:3]:
        if not punctuation(c):
            break
        ends.append(c)
    low = lambda w: None if w is None else "".join(c.lower() if c.isascii() else c for c in w)
    return case, tuple(ends), data[0] if punctuation(data[0]) else 0, low(word) == low(before), min(len(data).bit_length() - 1, 6), any(48 <= c <= 57 for c in data)


def plain_grams(text: str) -> set:
    """The distinct n-grams, unhashed."""
    words = [w for w in re.split(SPACE, text) if w]
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    classes = [word_class(w, words[i - 1] if i else None) for i, w in enumerate(words)]
    return {("word", *low[i : i + k]) for k in quality.WORDS for i in range(len(low) - k + 1)} | {("class", *classes[i : i + k]) for k in quality.CLASSES for i in range(len(words) - k + 1)}


TEXTS = ["", "One", "one ONE One.", "A b\tc\n\nA b", "éÉ!!! x1 ??", "THE!! END!!", "a " * 50, "%%% *** a%%%", "long" * 40 + " " + "x" * 300, " \n "]


def test_grams(monkeypatch):
    """As many distinct n-grams as a plain count finds, equal where texts are equal but for case of word n-grams; of each text alone."""
    monkeypatch.setattr(quality, "BITS", 40)  # no two meet by chance
    of, bucket = quality._sets(pa.array([*TEXTS, None]))
    for i, text in enumerate(TEXTS):
        alone = quality._sets(pa.array([text]))[1]
        assert sorted(bucket[of == i]) == sorted(alone) and len(alone) == len(plain_grams(text)), text
    for a in TEXTS:
        for b in TEXTS:
            both = [set(quality._sets(pa.array([x]))[1]) for x in (a, b)]
            assert len(both[0] & both[1]) == len(plain_grams(a) & plain_grams(b)), (a, b)


def test_descent_is_optimal(monkeypatch):
    """Descent goes to the optimum: primal and dual objective meet; at the tolerance in use they are within a thousandth."""
    g = np.random.default_rng(5)
    dense = (g.random((120, 30)) < 0.2) * g.normal(size=(120, 30))
    y = np.where(dense[:, :3].sum(axis=1) + 0.3 * g.normal(size=120) > 0, 1.0, -1.0)
    rows, cost = [np.flatnonzero(x) for x in dense], np.where(y > 0, 1.0, 2.0)
    x, values = np.c_[dense, np.ones(120)], [x[r] for x, r in zip(dense, rows, strict=True)]
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    in_use = primal(quality.descend(rows, values, y, cost, 30, 3000))
    monkeypatch.setattr(quality, "TOLERANCE", 1e-7)
    exact = primal(quality.descend(rows, values, y, cost, 30, 3000))
    dual = np.zeros(120)
    for _ in range(20_000):  # the same by plain steps along the gradient, short enough for its greatest curvature
        dual = np.clip(dual + (1 - y * (x @ ((dual * y) @ x))) / np.linalg.norm(x, 2) ** 2, 0, cost)
    u = (dual * y) @ x
    assert exact == pytest.approx(dual.sum() - u @ u / 2, rel=1e-5) and exact <= in_use <= 1.001 * exact


def labelled(n: int, seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, " ".join(word().upper() + "!!" if bad and r.random() < 0.5 else word() for _ in range(r.randint(5, 80)))))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, 1, "h", "g", 2, "l", "q") for i, t in docs], SCHEMA), spark.createDataFrame([(i, x, "t") for i, x in labels], "doc_id long, quality int, text string")


def test_ratios(spark):
    """Ratios follow from counts of texts that have an n-gram, each text once."""
    docs, labels = labelled(60, 2)
    docs += [docs[0], (900, docs[3][1]), (901, None), (None, "no id")]
    labels += [(900, 1), (901, 0), (950, 1), (None, 1), (7, None), (3, 1)]
    model = quality.train(*frames(spark, docs, labels))
    texts = {c: {t for i, t in docs if i is not None and i < 901 and t and ((i % 4 == 0) if i < 900 else False) == (c == 0)} for c in (0, 1)}
    counts = {c: np.zeros(1 << quality.BITS, int) for c in (0, 1)}
    for c, some in texts.items():
        for t in some:
            counts[c][quality._sets(pa.array([t]))[1]] += 1
    kinds = (counts[0] + counts[1] > 0).sum()
    share = [(counts[c][model["buckets"]] + quality.ALPHA) / (counts[c].sum() + quality.ALPHA * kinds) for c in (0, 1)]
    assert model["ratio"] == pytest.approx(np.log(share[1] / share[0]))
    assert set(model["buckets"]) == set(np.flatnonzero(counts[0] + counts[1] > 1))


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeats, clashing columns; no labels, one class, no documents."""
    docs, labels = labelled(80, 3)
    docs += [(100, None), (101, ""), (102, "WORD!! " * 40_000), (103, "plain words here " * 30_000), (None, "BAD!! WORDS!!"), docs[4], docs[5]]
    frame, known = frames(spark, docs, labels)
    model = quality.train(frame, known)
    got = sorted(((r.doc_id, r.score) for r in quality.score(frame, model).collect()), key=str)
    assert len(got) == len(docs) and [i for i, _ in got] == sorted((i for i, _ in docs), key=lambda i: str((i, 0)))
    by = dict(got)
    assert all(0 <= s <= 1 for _, s in got) and by[100] == by[101] and by[102] < 0.5 < by[103] and by[None] < 0.5
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in docs if i is not None and by[i] >= 0.5)
    none, no_labels = frame.where("false"), known.where("false")
    for d, la, share in ((none, known, 0.75), (frame, no_labels, 0.5), (frame, known.where("quality = 1"), 0.999)):
        model = quality.train(d, la)
        assert {round(r.score, 3) for r in quality.score(frame, model).collect()} == {share}
    assert quality.score(none, model).count() == 0
    blank = spark.createDataFrame([(1, " ", 0, "", "", 0, "", ""), (2, "", 0, "", "", 0, "", "")], SCHEMA)
    assert {r.score for r in quality.score(blank, quality.train(blank, frames(spark, [], [(1, 0), (2, 1)])[1])).collect()} == {0.5}


@pytest.mark.parametrize("at, least", [("/root/testdata/sf0.01", 0.97), ("/root/testdata/sf0.1", 0.99)])
def test_held_out(spark, at, least):
    got = quality.op13_quality(spark, at)
    assert got.count() == spark.read.parquet(f"{at}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in got.collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out]
    for c in (0, 1):
        own = [p == q for p, q in held if q == c]
        assert sum(own) >= least * len(own)


def test_labels_alone_are_learnt_from(spark, sf):
    """Other columns of documents and labels of held-out rows change nothing."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = quality.train(docs, labels.where(quality.fold("doc_id", 3) != 1))
    b = quality.train(docs.withColumn("lang", F.lit("x")).drop("source"), labels.where(quality.fold("doc_id", 3) != 1).withColumn("toxic", F.lit(1)))
    assert all(np.array_equal(a[k], b[k]) for k in a)
