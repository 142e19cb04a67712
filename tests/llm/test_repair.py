"""Repair of conversations against all edits of short ones, and against a plain scan of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import same_rows

from tabweave.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, n long, place long, cost double"
LETTER = re.compile(r"[^\x20\x09-\x0D]")


def ordered(rows: list) -> list:
    """(turn, role, text) in order, nulls as one space."""
    plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def faults(rows: list) -> list:
    out, seen = [], set()
    for _, role, text in rows:
        found = LETTER.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def counts(rows: list) -> dict:
    by, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    out = {f: by.count(f) for f in ("blank", "duplicate", "truncated")}
    return out | {"illegal": sum(p not in ("su", "ua", "au") for p in pairs), "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}


def all_edits(rows: list) -> tuple:
    """(cost, audit, repaired turns) of the cheapest of all edits, tried one by one."""
    by, found = faults(rows), []
    gap = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]

    def edits(k):
        _, role, text = rows[k]
        yield 2, "D", []
        if by[k] not in ("blank", "duplicate"):
            more = 5 * (by[k] == "truncated")
            yield more, "K", [(role, text)]
            yield from ((1 + more, "R", [(x, text)]) for x in ("user", "assistant"))

    for put in itertools.product(gap, repeat=len(rows) + 1):
        for some in itertools.product(*(list(edits(k)) for k in range(len(rows)))):
            turns, audit, cost = [], "", 0
            for k, added in enumerate(put):
                turns += [({"u": "user", "a": "assistant"}[x], "") for x in added]
                audit, cost = audit + "I" * len(added), cost + 5 * len(added)
                if k < len(rows):
                    turns, audit, cost = turns + some[k][2], audit + some[k][1], cost + some[k][0]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found.append((cost, audit, turns))
    return min(found, key=lambda x: x[:2])


def scan(rows: list) -> tuple:
    """(cost, audit) of the cheapest edits, turn by turn, from whole audits at each of the four states."""
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def put_in(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                for x in "ua":
                    if (s, x) in to:
                        t = to[s, x]
                        best[t] = min(best.get(t, (1e18, "")), (c + 5, a + "I"))
        return best

    best = put_in(best)
    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        new: dict = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 2, a + "D")]
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                ways += [(to[s, x], c + 1, a + "R") for x in "ua" if (s, x) in to]
                if (s, role[:1]) in to:
                    ways.append((to[s, role[:1]], c, a + "K"))
            for t, cost, audit in ways:
                new[t] = min(new.get(t, (1e18, "")), (cost, audit))
        best = put_in(new)
    return min(best[s] for s in ("", "a") if s in best)


def applied(rows: list, audit: str) -> list:
    """What an audit makes of the rows: where it rewrites or puts in a turn, the role is the one that may follow."""
    out, k = [], 0
    for edit in audit:
        role, text = rows[k][1:] if edit != "I" else (None, "")
        k += edit != "I"
        if edit != "D":
            out.append((role if edit == "K" else "assistant" if out and out[-1][0][:1] == "u" else "user", text))
    assert k == len(rows)
    return out


def digest(turns: list) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def hold(spark, conversations: dict, exact) -> None:
    rows = [(c, *row, "x", 1, 2, 0.5) for c, some in conversations.items() for row in some]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in repair.repair(frame).collect()}
    turns: dict = {}
    for r in sorted(repair.repaired(frame).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == {c for c, some in conversations.items() if some}
    for c, some in conversations.items():
        if some:
            want, row = ordered(some), got[c].asDict()
            cost, audit, *said = exact(want)
            left = said[0] if said else applied(want, audit)
            assert {k: row[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")} == counts(want), want
            assert (row["cost"], row["audit"]) == (cost, audit), want
            assert turns.get(c, []) == left and row["repaired_sha256"] == digest(left), want


TEXTS = ["Yes.", "No", " \t\n", "", "Why? \n", "a.b", None]


def test_all_edits_of_short_conversations(spark):
    r = random.Random(7)
    some = {c: [(r.choice([None, 0, 1, 2, 5]), r.choice(["system", "user", "assistant", "assistant", "tool", "", None]), r.choice(TEXTS)) for _ in range(r.randint(1, 3))] for c in range(60)}
    some |= {None: [(0, "user", "Hi."), (0, "user", "Hi."), (1, "assistant", "Yes!")], 99: []}
    hold(spark, some, all_edits)


def test_matrices_equal_the_scan():
    """Products in any grouping give what the plain scan gives."""
    r = random.Random(9)
    for _ in range(200):
        rows = ordered([(k, r.choice(["system", "user", "assistant", "x"]), r.choice(TEXTS[:6]) + r.choice(["", str(k), "."])) for k in range(r.randint(0, 12))])
        runs = [(t, role, text, 1, f == "duplicate") for (t, role, text), f in zip(rows, faults(rows), strict=True)]
        parts = [repair._matrix(repair.ONE, [x]) for x in runs]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [repair.times(parts[i], parts[i + 1])]
        assert repair.best(repair.times([repair.CLOSED[repair.START]], parts[0] if parts else repair.ONE)) == scan(rows)


def test_long_conversations_in_parts(spark, monkeypatch):
    """One of 4000 turns over all partitions, some of a few parts, many copies; the tree multiplies three at a time."""
    monkeypatch.setattr(repair, "CHUNK", 40)
    monkeypatch.setattr(repair, "FAN", 3)
    r = random.Random(3)
    long = [(k if k % 17 else None, r.choice(["user", "assistant", "assistant", "system", "tool"]), r.choice(["Same.", f"said {k}", f"Said {k}. ", "x" * 200 + f"{k}?"])) for k in range(4000)]
    some = {1: long, 2: [(3, "user", "again.")] * 500 + [(4, "assistant", "So.")], 3: [(2**63 - 1, "user", "One."), (-(2**63) + 5, "assistant", "Two.")]}
    some |= {c: [(k, "user assistant".split()[k % 2], f"Turn {k}.") for k in range(c)] for c in range(30, 90)}
    frame = spark.createDataFrame([(c, *row, "x", 1, 2, 0.5) for c, rows in some.items() for row in rows], SCHEMA)
    got = {x.conv_id: x for x in repair.repair(frame).collect()}
    for c, rows in some.items():
        want, (cost, audit) = ordered(rows), scan(ordered(rows))
        expected = counts(want) | ({"gaps": None} if c == 3 else {})
        assert {k: got[c][k] for k in expected} == expected and (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, digest(applied(want, audit)))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and repair.repaired(none).count() == 0


def test_query_equals_sql(spark, sf, duck):
    same_rows(repair.op12_repair(spark, sf).toPandas(), duck.sql(repair.OP12_SQL).df())


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, at):
    rows: dict = {}
    for x in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        own = rows.setdefault(x.conv_id, [])
        by = zlib.crc32(f"{x.conv_id}:{x.turn}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", x.text) if by == 2 else x.text
        own += [(x.turn, "user" if by == 4 else x.role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    got = {x.conv_id: x for x in repair.op12_repair(spark, at).collect()}
    assert set(got) == set(rows)
    for c, some in rows.items():
        want = ordered(some)
        cost, audit = scan(want)
        expected = counts(want) | {"cost": cost, "audit": audit, "repaired_sha256": digest(applied(want, audit))}
        assert {k: got[c][k] for k in expected} == expected
