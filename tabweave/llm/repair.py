"""Operator 12: cheapest repair of the turns of a conversation, by a scan over min-plus matrices.

Turns are kept, given the other role, deleted, or put in, so that roles read `(system? (user assistant)+)?`. That language has
four states (start, after system, after user, after assistant). A turn is a 4x4 matrix: for each state before and after it,
the cheapest edits as (cost, audit), with any turns put in after it (the closure of insertions). Matrices are
multiplied by (min, +) on costs, audits being joined; of equal costs the audit that is ASCII-least stays. Insertions cost
more than nothing, so of two audits of equal cost over the same turns neither is a beginning of the other: the product is associative and
monotone, and turns may be combined in any grouping.

Turns are sorted over all machines by conversation and number. A task multiplies the matrices of each conversation that
begins and ends inside its partition, and repairs it at once, from at most CHUNK rows in memory. Of a conversation that is longer or crosses partitions it
gives the product of each part; these few are multiplied in a tree, FAN at a time. The digest of such a conversation's repaired text is sequential by
definition, so its rows pass through one task as a sorted stream, which holds a batch of them and the audit.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Different rows, and characters of text, of a conversation that a task holds at once.
CHUNK, CHUNK_CHARS = 512, 16 << 20
#: Products of parts that are multiplied at once.
FAN = 16
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SPACE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by the state before.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
_FIT = (1 << 63) - 1


def times(a: list, b: list) -> list:
    """The product of rows of (cost, audit) with a matrix; None where there is no way."""
    out = []
    for row in a:
        new = [None] * 4
        for x, ways in zip(row, b, strict=True):
            if x is not None:
                for t, y in enumerate(ways):
                    if y is not None:
                        way = (x[0] + y[0], x[1] + y[1])
                        if new[t] is None or way < new[t]:
                            new[t] = way
        out.append(new)
    return out


def _least(a: tuple | None, b: tuple | None) -> tuple | None:
    return min((x for x in (a, b) if x is not None), default=None)


ONE = [[(0, "") if s == t else None for t in range(4)] for s in range(4)]


def _closure() -> list:
    """Any number of turns put in."""
    once = [[(INSERT, "I") if any(MOVES[i].get(s) == t for i in "ua") else None for t in range(4)] for s in range(4)]
    total = ONE
    for _ in range(3):  # three turns lead from any state to any that can be reached
        total = [[_least(x, y) for x, y in zip(*rows, strict=True)] for rows in zip(ONE, times(total, once), strict=True)]
    return total


CLOSED = _closure()


def _turn(initial: str, deleted: bool, cut: bool) -> list:
    m = [[None] * 4 for _ in range(4)]
    for s in range(4):
        ways = [(s, (DELETE, "D"))]
        if not deleted:
            ways += [(MOVES[i][s], (REROLE + TRUNCATED * cut, "R")) for i in "ua" if s in MOVES[i]]
            ways += [(t, (TRUNCATED * cut, "K")) for x, t in MOVES.get(initial, {}).items() if x == s]
        for t, way in ways:
            m[s][t] = _least(m[s][t], way)
    return times(m, CLOSED)


#: Matrices of turns by initial (one for all others), whether they must go and whether they are cut short.
TURNS = {(i, deleted, cut): _turn(i, deleted, cut) for i in ("s", "u", "a", "") for deleted in (False, True) for cut in (False, True)}


def _power(m: list, n: int) -> list:
    out = ONE
    while n:
        out = times(out, m) if n & 1 else out
        m, n = times(m, m) if n > 1 else m, n >> 1
    return out


def _fault(text: str, earlier: bool) -> str:
    """The first fault of a turn; its further copies are blank or duplicates."""
    end = text.rstrip(_SPACE)
    return "blank" if not end else "duplicate" if earlier else "truncated" if end[-1] not in ".!?" else ""


def _matrix(start: list, rows: list) -> list:
    """The start times the matrices of all rows (turn, role, text, copies, earlier)."""
    for _, role, text, n, earlier in rows:
        fault, initial = _fault(text, earlier), role[:1] if role[:1] in MOVES else ""
        start = times(start, TURNS[initial, fault in ("blank", "duplicate"), fault == "truncated"])
        if n > 1:
            start = times(start, _power(TURNS[initial, True, False], n - 1))
    return start


def best(rows_from_start: list) -> tuple:
    """The cheapest (cost, audit) that ends with nothing or after an assistant's turn, from the first row of a product."""
    first = rows_from_start[0]
    return _least(first[START], first[ASSISTANT])


class Walk:
    """Applies an audit to rows in order; gives (role, text) of what stays or is put in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _put(self, role: str | None = None, text: str = "") -> tuple[str, str]:
        role = role if role is not None else "assistant" if self.state == USER else "user"
        self.state = MOVES[role[0]][self.state]
        return role, text

    def insertions(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put()

    def row(self, role: str, text: str, n: int):
        for _ in range(n):
            yield from self.insertions()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                yield self._put(role if edit == "K" else None, text)


#: The counts and ends of a part of a conversation, which are combined beside its matrix.
_NUMBERS = ("illegal", "blank", "duplicate", "truncated", "low", "high", "turns")
_PART = ("first", "last", *_NUMBERS)
_PART_TYPES = "first string, last string, " + ", ".join(f"{c} long" for c in _NUMBERS)


def _seen(rows: list) -> dict:
    out = dict.fromkeys(_PART, 0) | {"first": rows[0][1][:1], "last": rows[-1][1][:1], "low": None, "high": None}
    before = None
    for turn, role, text, n, earlier in rows:
        fault, initial = _fault(text, earlier), role[:1]
        if fault:
            out[fault] += 1
        out["blank" if fault == "blank" else "duplicate"] += n - 1
        out["illegal"] += n - 1 + (before is not None and before + initial not in LEGAL)
        if turn is not None:
            out["turns"] += turn != out["high"]
            out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
        before = initial
    return out


def _both(a: dict, b: dict) -> dict:
    """The parts one after the other."""
    out = {c: a[c] + b[c] for c in ("illegal", "blank", "duplicate", "truncated", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def _gaps(x: dict) -> int | None:
    gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
    return gaps if gaps <= _FIT else None


def _batch(ids: pa.Array, rows: list[dict], types: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    columns = [c.split(" ") for c in types.split(", ")]
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r.get(c) for r in rows], kinds[k]) for c, k in columns)], ["conv_id", *(c for c, _ in columns)])


_PARTS = f"whole boolean, place long, at long, {_PART_TYPES}, gaps long, cost long, audit string, repaired_sha256 string, costs array<long>, audits array<string>"
_OUT = ("illegal", "blank", "duplicate", "truncated")


def _flat(m: list) -> dict:
    cells = [x for row in m for x in row]
    return {"costs": [x and x[0] for x in cells], "audits": [x and x[1] for x in cells]}


def _square(x: dict) -> list:
    cells = [None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True)]
    return [cells[i : i + 4] for i in range(0, 16, 4)]


def _sum_up(rows: list, whole: bool) -> dict:
    """A conversation with its repair, or a part of one with its product."""
    seen = _seen(rows)
    if not whole:
        return seen | {"whole": False} | _flat(_matrix(ONE, rows))
    cost, audit = best(_matrix([CLOSED[START]], rows))
    walk = Walk(audit)
    kept = [x for _, role, text, n, _ in rows for x in walk.row(role, text, n)] + list(walk.insertions())
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in kept).encode()).hexdigest()
    return seen | {"whole": True, "gaps": _gaps(seen), "cost": cost, "audit": audit, "repaired_sha256": digest}


def _parts(batches):
    """Conversations of a sorted partition; the first and the last one may go on in others, so these are parts, as are stretches of long ones."""
    place, made = TaskContext.get().partitionId(), 0
    kind, held, chars, open_, out = None, [], 0, True, []
    conv = None

    def flush(whole: bool):
        nonlocal held, chars, made
        if held:
            row = _sum_up(held, whole) | {"place": place, "at": made}
            made += not whole
            out.append((conv, row))
        held, chars = [], 0

    def emit():
        nonlocal out
        ready, out = out, []
        return _batch(pa.array([c for c, _ in ready], kind), [r for _, r in ready], _PARTS)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for of, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "earlier")), strict=True):
            if held and of != conv:
                flush(not open_)
                open_ = False
            elif len(held) >= CHUNK or chars > CHUNK_CHARS:
                flush(False)
                open_ = True  # the rest of this conversation is in parts too
            conv = of
            held.append(row)
            chars += len(row[2])
        if out:
            yield emit()
    if held:
        flush(False)
        yield emit()


def _products(batches):
    """One part in place of several that follow each other."""
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            total, matrix = parts[0], _square(parts[0])
            for p in parts[1:]:
                total, matrix = _both(total, p), times(matrix, _square(p))
            rows.append({c: total[c] for c in _PART} | _flat(matrix) | {"at": parts[0]["at"]})
        yield _batch(batch.column("conv_id"), rows, _JOINED)


_JOINED = f"at long, {_PART_TYPES}, costs array<long>, audits array<string>"


def _chosen(batches):
    for batch in batches:
        rows = []
        for part in batch.to_pylist():
            cost, audit = best(times([CLOSED[START]], _square(part)))
            rows.append({c: part[c] for c in _OUT} | {"gaps": _gaps(part), "cost": cost, "audit": audit})
        yield _batch(batch.column("conv_id"), rows, _CHOSEN)


_CHOSEN = "gaps long, illegal long, blank long, duplicate long, truncated long, cost long, audit string"
_SORTED = ["conv_id", "turn", "role", "text"]


def _walked(batches, end):
    """Rows sorted by conversation, an audit before its turns: end(conversation, turns) gets what each conversation's rows become, as a stream for each batch and whether it is the last."""
    conv, walk, some = None, None, False
    for batch in batches:
        kept = []
        for of, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n")), strict=True):
            if audit is not None:
                if some:
                    kept += [(conv, *x) for x in walk.insertions()]
                    kept.append((conv, None, None))
                conv, walk, some = of, Walk(audit), True
            else:
                kept += [(of, *x) for x in walk.row(role, text, n)]
        yield end(kept, batch.schema.field("conv_id").type)
    if some:
        yield end([*((conv, *x) for x in walk.insertions()), (conv, None, None)], batch.schema.field("conv_id").type)


def _rows_out(batches):
    at = -1

    def end(kept, kind):
        nonlocal at
        rows = []
        for of, role, text in kept:
            at = -1 if role is None else at + 1
            if role is not None:
                rows.append((of, {"place": at, "role": role, "text": text}))
        return _batch(pa.array([c for c, _ in rows], kind), [r for _, r in rows], "place long, role string, text string")

    yield from _walked(batches, end)


def _digests(batches):
    digest, some = hashlib.sha256(), False

    def end(kept, kind):
        nonlocal digest, some
        done = []
        for of, role, text in kept:
            if role is None:
                done.append((of, {"repaired_sha256": digest.hexdigest()}))
                digest, some = hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) * some}{role}:{text}".encode())
                some = True
        return _batch(pa.array([c for c, _ in done], kind), [r for _, r in done], "repaired_sha256 string")

    yield from _walked(batches, end)


def _runs(turns: DataFrame, id_col: str, step: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, n, earlier): equal rows once with their number; earlier: a row of a lesser turn has the same role and text."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(step).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    hashes = [F.xxhash64(F.lit(i), F.col("text")).alias(c) for i, c in ((1, "h"), (2, "g"))]
    runs = staged(rows.groupBy(*_SORTED).agg(F.count("*").alias("n")).select("*", *hashes), "runs")
    number = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = runs.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("h").alias("h1"), F.col("g").alias("g1")).agg(F.min(number).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1"))
    return runs.join(again, same, "left").select(*_SORTED, "n", (F.col("first").isNotNull() & ~number.eqNullSafe(F.col("first"))).alias("earlier"))


def _tree(parts: DataFrame, kind: str) -> DataFrame:
    """One part for each conversation, parts that follow each other being multiplied FAN at a time."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("place").agg(F.count("*").alias("k")).select("place", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))  # a row for each partition
    left = parts.join(bases, "place").withColumn("at", F.col("base") + F.col("at")).select("conv_id", *(c.split(" ")[0] for c in _JOINED.split(", ")))
    names = [c for c in left.columns if c != "conv_id"]
    while True:
        left = staged(left, "parts")
        if left.groupBy("conv_id").count().where("count > 1").isEmpty():
            return left
        groups = left.groupBy("conv_id", F.floor(F.col("at") / FAN).alias("group")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("parts"))
        left = groups.mapInArrow(_products, f"conv_id {kind}, {_JOINED}").withColumn("at", F.floor(F.col("at") / FAN))


def _stream(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition; sorted, not held."""
    rows = runs.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n")
    first = audits.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"))))
    return first.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_SORTED[1:])


def _repair(runs: DataFrame, kind: str) -> DataFrame:
    placed = runs.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*_SORTED)
    parts = staged(placed.mapInArrow(_parts, f"conv_id {kind}, {_PARTS}"), "conversations")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = parts.where("whole").select(*names, "repaired_sha256")
    rest = staged(_tree(parts.where("NOT whole"), kind).mapInArrow(_chosen, f"conv_id {kind}, {_CHOSEN}"), "long")
    own = runs.alias("r").join(rest.alias("l"), F.expr("r.conv_id <=> l.conv_id"), "left_semi").select("r.*")
    digests = _stream(own, rest).mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string").select(F.col("conv_id").alias("of"), "repaired_sha256")
    return whole.unionByName(rest.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select(*names, "repaired_sha256"))


def repair(turns: DataFrame, id_col: str = "conv_id", step: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation that has a row.

    Turns go by number (nulls first), then role and text. A null role or text counts as one space; a null conversation is one of its own. Rows that
    are equal throughout are copies: all but the first are duplicates. A role counts by its first character. gaps is null where
    it doesn't fit 64 bits. An empty table gives no row; other columns are not looked at. No conversation or text is too long: a
    conversation takes memory for CHUNK rows, and for sixteen audits of a letter a row where its parts are multiplied.
    """
    kind = dict(turns.dtypes)[id_col]
    return _repair(staged(_runs(turns, id_col, step, role, text), "turns"), kind)


def repaired(turns: DataFrame, id_col: str = "conv_id", step: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text): the turns of every repaired conversation, numbered from 0; one that is left without turns has no row."""
    kind = dict(turns.dtypes)[id_col]
    runs = staged(_runs(turns, id_col, step, role, text), "turns")
    audits = _repair(runs, kind).select("conv_id", "audit")
    return _stream(runs, audits).mapInArrow(_rows_out, f"conv_id {kind}, place long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults that follow from crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's; nulls become one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", "role", "text", by.alias("by")).where("by != 0")
    text: Column = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode_outer(F.array_repeat(F.lit(0), F.when(F.col("by") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; one whose rows are all dropped has zeros, an empty audit and the digest of nothing."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.col("audit").isNull()  # no row after the damage
    return every.select("conv_id", *(F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """Turn by turn, with the cheapest (cost, audit) at each of the four states; crc32 from its polynomial."""

    def way(state: str, cost: str, letters: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    drop = lambda s: way(s, str(DELETE), "D")
    new = lambda s: f"CASE WHEN NOT gone THEN {way(s, f'{REROLE} + more', 'R')} END"
    keep = lambda s, i: f"CASE WHEN NOT gone AND initial = '{i}' THEN {way(s, 'more', 'K')} END"
    put = lambda s, n=1: way(s, str(INSERT * n), "I" * n)
    white = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS n, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
named AS (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS n FROM conversations),
hit AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, crc),
damaged AS (
  SELECT n, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY n, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^{white}])[{white}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY n ORDER BY i) || initial AS pair FROM placed),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM judged),
sums AS (
  SELECT n, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY n),
scan AS (
  SELECT n, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1, {{'c': {INSERT}::BIGINT, 'a': 'I'}} AS s2, {{'c': {2 * INSERT}::BIGINT, 'a': 'II'}} AS s3 FROM sums
  UNION ALL
  SELECT n, i, t0, t1, {least('t2', put('t0'), put('t1'), put('t3'))}, {least('t3', put('t2'), put('t0', 2), put('t1', 2))} FROM (
    SELECT r.n, r.i, {drop('s0')} AS t0, {least(drop('s1'), keep('s0', 's'))} AS t1,
      {least(drop('s2'), *(f(s) for s in ('s0', 's1', 's3') for f in (new, lambda s: keep(s, 'u'))))} AS t2, {least(drop('s3'), new('s2'), keep('s2', 'a'))} AS t3
    FROM scan JOIN r ON r.n = scan.n AND r.i = scan.i + 1)),
best AS (SELECT n, {least('s0', 's3')} AS b FROM scan JOIN sums USING (n) WHERE i = rows),
letters AS (SELECT n, unnest(string_split(b.a, '')) AS x, generate_subscripts(string_split(b.a, ''), 1) AS p FROM best WHERE b.a <> ''),
edits AS (SELECT *, sum((x <> 'I')::INT) OVER (PARTITION BY n ORDER BY p) AS i, sum((x <> 'D')::INT) OVER (PARTITION BY n ORDER BY p) AS k FROM letters),
kept AS (
  SELECT e.n, e.p, e.x, e.k, r.role, CASE WHEN e.x = 'I' THEN '' ELSE r.text END AS text, max((e.x = 'K' AND e.k = 1 AND r.initial = 's')::INT) OVER (PARTITION BY e.n) AS begins
  FROM edits e LEFT JOIN r ON r.n = e.n AND r.i = e.i WHERE e.x <> 'D'),
said AS (SELECT n, string_agg(CASE WHEN x = 'K' THEN role WHEN (k - begins) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS said FROM kept GROUP BY n)
SELECT conv_id, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM named LEFT JOIN sums USING (n) LEFT JOIN best USING (n) LEFT JOIN said USING (n)
"""


OP12_SQL = _sql()
