"""Texts of over a megabyte beside short ones, where the general tests hold texts of some ten kilobytes."""

import math
import random

import numpy as np
import pytest

from tabweave.llm import lm, quality, simhash, substrings, toxicity
from tests.llm.test_operators import fingerprint, plain_model, split


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(90))
    long = [word() for _ in range(260_000)]
    return [(1, " ".join(long)), (2, " ".join([*long[:100_000], passage, *long[100_000:]]) + "\n" + passage), (3, passage), (4, "short"), (5, "one-line" * 160_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_language_model(docs, rows):
    _, _, p = plain_model([split(t) for _, t in rows])
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs)).collect()}
    for i, t in rows:
        w = [*split(t), b">"]
        assert got[i].n_tokens == len(w) and got[i].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([b"<", *w], w, strict=False)))


def test_simhash(docs, rows):
    assert {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()} == {i: fingerprint(t) for i, t in rows}


def test_substrings(docs, rows):
    data = [t.encode() for _, t in rows]
    hashes = [np.array([hash(b[s : s + 200]) for s in range(len(b) - 199)], np.int64) for b in data]
    kinds, times = np.unique(np.concatenate(hashes), return_counts=True)
    again = kinds[times > 1]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    for (i, _), b, h in zip(rows, data, hashes, strict=True):
        edge = np.zeros(len(b) + 1, np.int64)
        begins = np.flatnonzero(np.isin(h, again))
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + 200, -1)
        gone = np.cumsum(edge)[:-1] > 0
        assert got[i] == (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone, [0]])) == 1).sum()))


def test_classifiers_read_whole_texts(spark):
    """A word at the end of a long text counts as one at its beginning."""
    r = random.Random(4)
    plain = lambda n: " ".join(f"w{r.randint(0, 400)}" for _ in range(n))
    some = [(i, plain(60) + (" vile foul" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*some, (1000, plain(200_000) + " vile foul vile foul"), (1001, plain(200_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i, _ in some], "doc_id long, toxic int, quality int")
    spans = {x.doc_id: x.spans for x in toxicity.tag(docs, toxicity.train(docs, labels)).collect()}
    text = dict(map(tuple, docs.where("doc_id >= 1000").collect()))[1000]
    assert {text[s.start : s.end] for s in spans[1000]} and all(text[s.start : s.end] in ("vile", "foul") and s.start > 900_000 for s in spans[1000]) and not spans[1001]
    scores = {x.doc_id: x.score for x in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all((scores[i] < 0.5) == (i % 3 == 0) for i, _ in some) and scores[1000] < scores[1001]
