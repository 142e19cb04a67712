"""A search that answers from nothing, for the tests."""

import datetime
import os


def find(term, page):
    return [("o", "r", f"{term}{page}.csv"), ("o", "r", "x.txt")] if page == 1 else []


def find_papers(term, page, narrow=None, order=None):
    """Twelve papers of two categories and years, five a page; narrowing is told in the title."""
    rows = [(f"{term}/{i}", f"{order} {sorted((k, sorted(v.items())) for k, v in (narrow or {}).items())}", "cs.CL" if i % 2 else "econ", datetime.date(2020 + i % 3, 1, 1)) for i in range(12)]
    return rows[5 * (page - 1) : 5 * page]


def find_or_fail(term, page):
    """Hits on pages 1, 2 and 6 of each term; every call is written down below a folder that the term names, and none succeeds while `down` is there."""
    folder, name = term.rsplit("/", 1)
    if os.path.exists(f"{folder}/down") and page >= 2:
        raise ConnectionError(term)
    with open(f"{folder}/calls", "a") as f:
        f.write(f"{name}{page} ")
    return [(name, str(page), f"{k}.csv") for k in range(3)] if page in (1, 2, 6) else []
