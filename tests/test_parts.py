"""Scores of a batch that is counted in parts."""

import random

import numpy as np
import pandas as pd

from tabweave.functions import metrics as M
from tabweave.operators import collect
from tabweave.plans import catalogue


def test_scores_of_parts_are_those_of_the_whole(monkeypatch):
    r = random.Random(7)
    said = lambda: pd.Series([None if r.random() < 0.05 else " ".join(r.choices("abcdef", k=r.randrange(12))) for _ in range(400)])
    a, b = said(), said()
    sizes, pairs = [], M.Pairs
    monkeypatch.setattr(M, "Pairs", lambda p, t: sizes.append(sum(map(len, p)) + sum(map(len, t))) or pairs(p, t))
    whole = M.token_f1.func(a, b), M.adaptive_bleu.func(a, b)
    monkeypatch.setattr(M, "MOST_CHARS", 64)
    sizes.clear()
    got = M.token_f1.func(a, b), M.adaptive_bleu.func(a, b)
    assert all(np.array_equal(x, y) for x, y in zip(whole, got, strict=True))
    assert len(sizes) > 100 and max(sizes) < 80
    assert len(M.token_f1.func(a[:0], b[:0])) == 0


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    """Of random pages, those of nothing but tags and texts need no parser; the trees are the same."""
    r = random.Random(9)
    bits = ["<table>", "</table>", "<TR class=a>", "</tr>", "<td>", "</td>", "<th class='x caption' id=1>", "<thead>", "</thead >", "<br>", "<br/>", "<p hidden>", "</p>", "<figure>", "</figure>", "<figcaption CLASS=\"caption\">", "</figcaption>"]
    bits += ["<div class='a' class='caption'>", "<div class='a&amp;b > c'>", "x &amp; y", "a &lt b", " \n", "1 > 0", "<caption>", "</caption>", "&", "é", "2 < 3", "<!-- <td> -->", "<script>", "</script>", "<a b=c/d>", "<x-y>", "<td", "&copy", "<title>", "</", "<![CDATA["]
    tree = lambda e: [x if isinstance(x, str) else (x.tag, x.classes, tree(x)) for x in e.inside]

    def read(html):
        page = collect._Page(html)
        top = page.at
        while top.parent:
            top = top.parent
        return tree(top), [tree(t) for t in page.tables]

    pages = ["<table>" + "".join(r.choices(bits[: r.choice([20, 26, len(bits)])], k=r.randrange(15))) for _ in range(3000)] + ["", "x", "&amp", "<table"]
    plain, quick = [], collect._Page.plain
    monkeypatch.setattr(collect._Page, "plain", lambda self, html: plain.append(quick(self, html)) or plain[-1])
    got = [read(x) for x in pages]
    assert sum(plain) > 1000
    monkeypatch.setattr(collect._Page, "plain", lambda self, html: False)
    for page, one in zip(pages, got, strict=True):
        assert one == read(page), page


def test_pages_of_one_file_are_dealt_out(spark, sf):
    """A page goes to Python with others of its batch, and all cores have some."""
    plan = catalogue.QUERIES["html_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "hashpartitioning(p_partkey" in plan
