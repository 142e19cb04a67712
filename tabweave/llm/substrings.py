"""Operator 8: removal of repeated 200-byte strings by bucket-pointer refinement over sampled offsets.

Any 200-byte string holds 137 q-grams of 64 bytes, and the one with the smallest hash (the first of equal ones) is its bucket:
equal strings are in equal buckets and hold that q-gram at the same place, and consecutive offsets mostly share one. Offsets
that share it are a run, no two of whose strings are equal. Buckets are refined in rounds:

1. by what follows: a run's refined identifier is the hash of all bytes that its strings cover, up to the last one's end. Runs
   that share bucket and identifier start equal strings throughout and are done. Of a bucket, what is left are its runs that
   occur once, if there are others, and one run of each kind that occurs again, which they may share strings with;
2. those are refined offset by offset: the identifier of a string is made of its bucket, of the q-grams' identifiers there and
   64 further (a string of twice the length), and of the identifier made like that at the offset 72 further. Offsets that share
   it start equal strings of 200 bytes.

Each round shuffles identifiers alone, reduced within tasks first; its outcome is written to the shared folder as sorted arrays,
and the next pass over the texts looks up in those, memory-mapped. Texts themselves are never shuffled. Hashes are made of a
quarter of a megabyte at a time, which stays in a core's cache, and looked up for eight megabytes at a time, in files that hold
what some 64 MB of text or a million strings have, so that a lookup opens few files for many keys however large the table is.
Identifiers are content hashes of 64 bits, and 32 more are compared with them: among 10^11 strings, two different ones are taken
for equal with a probability of about one in ten million.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix, new_path, pieces, put_file, text_bytes

LENGTH, GRAM = 200, 64
#: Text looked up at once, and offsets hashed at once; longer texts are cut for that at multiples of CHUNK.
PIECE_BYTES, CHUNK = 8 << 20, 1 << 18
#: Text whose runs share a shard, and identifiers of strings that share one.
SHARD_BYTES, SHARD_STRINGS = 64 << 20, 1 << 20
#: Identifiers held by a map task before it passes them on.
HOLD = 3_000_000
_VALUE = mix(np.arange(101, 357, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
_HIGH, _LOW = np.uint64(2**64 - 2**32), np.uint64(2**32 - 1)
#: Leading bits that keys take from what they are dealt out by.
_DEALT = np.uint64(2**64 - 2**48)


def _power(n: int) -> list[np.ndarray]:
    """Powers of a number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = x.cumprod(dtype=np.uint64)
    return _powers


class Rolling:
    """Hashes of any byte ranges of some bytes, equal for equal bytes wherever they are."""

    def __init__(self, data: np.ndarray):
        up, down = _power(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * down[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])

    def all(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.up[: len(self.sums) - size])


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` consecutive values, by windows of twice the length."""
    n, reach = len(x) - size + 1, 1
    while 2 * reach <= size:
        x, reach = np.minimum(x[:-reach], x[reach:]), 2 * reach
    return np.minimum(x[:n], x[size - reach : size - reach + n])


def _order(keys: np.ndarray) -> np.ndarray:
    """What sorts the keys: their leading bits are sorted together with the places, which is faster than sorting places."""
    if not len(keys):
        return np.zeros(0, np.int64)
    bits = np.uint64(len(keys).bit_length())
    order = (np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    got = keys[order]
    return order[np.argsort(got, kind="stable")] if (got[1:] < got[:-1]).any() else order


def _ordered(keys: np.ndarray, then: np.ndarray) -> np.ndarray:
    """What sorts by keys and then by the other values, which are looked at where keys are equal."""
    order = _order(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    if (equal & (then[order[1:]] < then[order[:-1]])).any():
        tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        order[tied] = order[tied][np.lexsort((then[order[tied]], keys[order[tied]]))]
    return order


def _news(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _chunks(off: np.ndarray):
    """Stretches of the bytes: short texts together, long ones cut at the same places wherever they stand, with what the strings of the last offsets need."""
    off = off.tolist()
    begin = off[0]
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a > CHUNK:
            if begin < a:
                yield begin, a
            yield from ((c, min(c + CHUNK + LENGTH - 1, b)) for c in range(a, b, CHUNK))
            begin = b
        elif b - begin > CHUNK:
            yield begin, a
            begin = a
    if begin < off[-1]:
        yield begin, off[-1]


class Runs:
    """The runs of some texts. first, end: of the offsets in a run; bucket; whole: its refined identifier."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = text_bytes(texts)
        none = np.zeros(0, np.int64)
        parts = [(none, none, none.astype(np.uint64), none.astype(np.uint64)), *(self._cut(a, b) for a, b in _chunks(self.off) if b - a >= LENGTH)]
        self.first, self.end, self.bucket, self.whole = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _cut(self, a: int, b: int):
        rolling = Rolling(self.data[a:b])
        gram = rolling.all(GRAM)
        least = _least((gram & _HIGH) | np.arange(len(gram), dtype=np.uint64), LENGTH - GRAM + 1)  # one for each offset
        begins = self.off[np.searchsorted(self.off, a) : np.searchsorted(self.off, a + len(least))] - a
        first = np.sort(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, begins]))
        first = first[_news(first)]
        stop = self.off[np.searchsorted(self.off, first + a, side="right")]  # of each one's text, whose last offsets start no string
        end = np.minimum(np.append(first[1:], len(least)), stop - LENGTH + 1 - a)
        first, end = first[first < end], end[first < end]
        bucket = mix(gram[(least[first] & _LOW).astype(np.int64)])  # least hashes are small ones; their mixed values spread evenly over the shards
        return first + a, end + a, bucket, rolling.of(first, end - 1 + LENGTH)

    @property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return _run_keys(self.bucket, self.whole)

    def places(self, of: np.ndarray) -> np.ndarray:
        """Some bits of each run's place, by those of its text."""
        text = np.searchsorted(self.off, self.first, side="right") - 1
        return (mix(of[text] + (self.first - self.off[text]).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)

    def strings(self, pick: np.ndarray):
        """Some offsets of the picked runs at a time, and the keys and checks of the strings that start there."""
        pick = np.flatnonzero(pick)
        n = (self.end - self.first)[pick]
        for part in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(np.cumsum(n + LENGTH) // (8 * CHUNK))) + 1):
            if not len(part):
                continue
            first, end, size = self.first[pick[part]], self.end[pick[part]], n[part]
            cover = end + LENGTH - 1
            new = np.append(True, first[1:] > cover[:-1])
            begin, length = first[new], cover[np.append(new[1:], True)] - first[new]
            shift = np.cumsum(length) - length - begin  # the stretches that are needed are joined
            gram = Rolling(self.data[np.arange(length.sum()) - np.repeat(shift, length)]).all(GRAM)
            double = mix(gram[:-GRAM] + mix(gram[GRAM:]))
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            here = at + np.repeat(shift[np.cumsum(new) - 1], size)
            later = double[here + LENGTH - 2 * GRAM]
            yield at, mix(mix(np.repeat(self.bucket[pick[part]], size) + double[here]) + mix(later)), later.astype(np.uint32)


def _run_keys(bucket: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of runs, dealt out as their buckets, and checks."""
    return (bucket & _DEALT) | (mix(bucket + mix(whole)) >> np.uint64(16)), whole.astype(np.uint32)


class Sorted:
    """Sorted arrays of keys in the shared folder, by their leading bits, each with a check."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits

    def has(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Whether each key is there, with this check."""
        if len(keys) > HOLD:
            parts = [slice(a, a + HOLD) for a in range(0, len(keys), HOLD)]
            return np.concatenate([self.has(keys[p], None if checks is None else checks[p]) for p in parts])
        order = _order(keys)
        keys, out = keys[order], np.zeros(len(keys), bool)
        checks = np.zeros(len(keys), np.uint32) if checks is None else checks[order]
        for shard, a, b in _by_shard(keys, self.bits):
            table = mapped(f"{self.path}/{shard}", np.uint8)
            n = len(table) // 12
            if not n:
                continue
            known, check = table[: 8 * n].view(np.uint64), table[8 * n :].view(np.uint32)
            at = np.searchsorted(known, keys[a:b])
            more = np.arange(b - a)
            while len(more := more[(at[more] < n)][known[at[more[at[more] < n]]] == keys[a:b][more[at[more] < n]]]):  # those whose key stands there
                hit = check[at[more]] == checks[a:b][more]
                out[a:b][more[hit]] = True
                more = more[~hit]
                at[more] += 1
        back = np.empty(len(out), bool)
        back[order] = out
        return back


def _by_shard(keys: np.ndarray, bits: int):
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
        if b > a:
            yield int(shard[a]), int(a), int(b)


def _emit(bits: int, found, kinds):
    """found(piece): columns of these kinds, several times or once; the first one deals them out. Of rows that share the first two columns two are passed on, which tell that they occur again."""

    def packed(held):
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = _ordered(*columns[:2])
        again = ~_news(*(x[order] for x in columns[:2]))
        again[1:] &= again[:-1].copy()
        columns = [x[order[~again]].astype(kind, copy=False) for x, kind in zip(columns, kinds, strict=True)]
        rows = [(s, b"".join([x[a:b].tobytes() for x in columns])) for s, a, b in _by_shard(columns[0], bits)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "payload"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch, size=PIECE_BYTES):
                for columns in found(piece):
                    held.append(columns)
                    n += len(columns[0])
                    if n >= HOLD:
                        yield packed(held)
                        held, n = [], 0
        if n:
            yield packed(held)

    return run


def _bits(size: int, of_shard: int) -> int:
    """Leading bits of keys that name their shard: 32 shards or more, and of the bits that keys take over."""
    return min(16, max(5, (size // of_shard).bit_length()))


def _unpacked(table: pa.Table, kinds) -> list[np.ndarray]:
    width, parts = sum(np.dtype(k).itemsize for k in kinds), []
    for blob in table.column("payload").to_pylist():
        n, at, row = len(blob) // width, 0, []
        for kind in kinds:
            row.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append(row)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _put(path: str, key: np.ndarray, check: np.ndarray) -> None:
    order = _ordered(key, check)
    put_file(path, [key[order], check[order]])


_RUN, _STRING = (np.uint64, np.uint64, np.uint32, np.uint8), (np.uint64, np.uint32)


def _settle_runs(path: str):
    """Writes the shard's runs that occur again, the buckets that are left, and the runs that stand in them for those that occur again; returns how many strings are left."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        bucket, whole, place, length = _unpacked(table, _RUN)
        order = _ordered(bucket, whole)
        bucket, whole, place, length = (x[order] for x in (bucket, whole, place, length))
        kind = np.flatnonzero(_news(bucket, whole))
        again = np.diff(np.append(kind, len(bucket))) > 1
        bucket, whole, place, length = bucket[kind], whole[kind], np.minimum.reduceat(place, kind), length[kind]
        begin = np.flatnonzero(_news(bucket))
        size = np.diff(np.append(begin, len(bucket)))
        left = np.repeat((size > 1) & ~np.logical_and.reduceat(again, begin), size)
        key, check = _run_keys(bucket, whole)
        _put(f"{path}/again/{shard}", key[again], check[again])
        _put(f"{path}/one/{shard}", key[again & left], place[again & left])
        buckets = np.unique(bucket[left])
        _put(f"{path}/left/{shard}", buckets, np.zeros(len(buckets), np.uint32))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([int(length[left].sum())], pa.int64())})

    return run


def _settle_strings(path: str):
    """Writes the shard's strings that occur again."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        key, check = _unpacked(table, _STRING)
        order = _ordered(key, check)
        key, check = key[order], check[order]
        new = _news(key, check)
        pick = new[:-1] & ~new[1:]
        put_file(f"{path}/again/{shard}", [key[:-1][pick], check[:-1][pick]])
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([int(pick.sum())], pa.int64())})

    return run


def _round(rows: DataFrame, bits: int, found, kinds, settle) -> tuple[str, int]:
    path = new_path(rows.sparkSession, "buckets")
    n = rows.mapInArrow(_emit(bits, found, kinds), "shard int, payload binary").groupBy("shard").applyInArrow(settle(path), "shard int, n long").agg(F.sum("n")).first()[0]
    return path, n or 0


def _placed(piece: pa.RecordBatch, runs: Runs) -> np.ndarray:
    return runs.places(piece.column("place").to_numpy().view(np.uint64))


def _runs_of(piece: pa.RecordBatch):
    runs = Runs(piece.column("text"))
    columns = runs.bucket, runs.whole, _placed(piece, runs), (runs.end - runs.first).astype(np.uint8)
    yield from ([x[a : a + HOLD] for x in columns] for a in range(0, len(runs.first), HOLD))


def _strings_of(again: Sorted, one: Sorted, left: Sorted):
    """The strings that the first round has left."""

    def found(piece: pa.RecordBatch):
        runs = Runs(piece.column("text"))
        pick = left.has(runs.bucket)
        key, check = (x[pick] for x in runs.keys)
        known = again.has(key, check)
        known[known] = ~one.has(key[known], _placed(piece, runs)[pick][known])
        pick[pick] = ~known
        for _, key, check in runs.strings(pick):
            yield key, check

    return found


def _without(piece: pa.RecordBatch, runs: Runs, begin: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """The piece's texts without some stretches, which may overlap."""
    off, order = runs.off, np.argsort(begin, kind="stable")
    begin, stop = begin[order], np.maximum.accumulate(stop[order])
    text = np.searchsorted(off, begin, side="right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > stop[:-1]) | (text[1:] != text[:-1])
    begin, stop, text = begin[new], stop[np.append(new[1:], True)[: len(new)]], text[new]
    kept = np.repeat(np.arange(2 * len(begin) + 1) % 2 == 0, np.diff(np.concatenate([[0], np.stack([begin, stop], 1).ravel(), [len(runs.data)]])))
    gone = np.zeros(len(off), np.int64)
    np.add.at(gone, text + 1, stop - begin)
    spans = np.bincount(text, minlength=len(off) - 1)
    to = np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)
    ends = (off - np.cumsum(gone)).astype(np.int32)
    columns = {
        "doc_id": piece.column("doc_id"),
        "n_bytes": pa.array(np.diff(off)),
        "n_removed": pa.array(gone[1:]),
        "n_spans": pa.array(spans.astype(np.int64)),
        "kept": pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(ends), pa.py_buffer(runs.data[kept])]),
        "spans": pa.ListArray.from_arrays(pa.array(to), pa.StructArray.from_arrays([pa.array(begin - off[text]), pa.array(stop - off[text])], ["start", "end"])),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): each text's bytes without those that a repeated 200-byte string covers.

    kept: binary, as cuts may part the bytes of a character; spans: start and end of the maximal removed runs. A null text
    is an empty one; texts under 200 bytes stay whole. Repeated rows are texts of their own, so each is removed in full. An
    empty table gives no row; other columns are not looked at. A text takes some 6 bytes of a worker's memory for each of its
    bytes, one of a single repeated character 100.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.select("text", F.xxhash64("text").alias("place"))  # by the text alone, which is the same in every pass
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(size, SHARD_BYTES)
    path, n = _round(placed, bits, _runs_of, _RUN, _settle_runs)
    again, one, left = (Sorted(f"{path}/{name}", bits) for name in ("again", "one", "left"))
    bits = _bits(n, SHARD_STRINGS)
    strings = Sorted(f"{_round(placed, bits, _strings_of(again, one, left), _STRING, _settle_strings)[0]}/again", bits)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, size=PIECE_BYTES):
                runs = Runs(piece.column("text"))
                whole = again.has(*runs.keys)
                pick = ~whole
                pick[pick] = left.has(runs.bucket[pick])
                begin, stop = [runs.first[whole]], [runs.end[whole] - 1 + LENGTH]
                for at, key, check in runs.strings(pick):
                    at = at[strings.has(key, check)]
                    begin.append(at)
                    stop.append(at + LENGTH)
                yield _without(piece, runs, np.concatenate(begin), np.concatenate(stop))

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, p, md5(hex(b[p:p + 199])) AS w FROM d, unnest(range(1, n - 198)) AS t(p)),
r AS (SELECT doc_id, p FROM s WHERE w IN (SELECT w FROM s GROUP BY w HAVING count(*) > 1)),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM r)),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 199 AS e FROM i GROUP BY doc_id, k),
edges AS (SELECT doc_id, e + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS e FROM (SELECT doc_id, a, e FROM spans UNION ALL SELECT doc_id, 0, 0 FROM d)),
kept AS (SELECT d.doc_id, string_agg(CASE WHEN x.e > x.a THEN hex(d.b[x.a:least(x.e - 1, d.n)]) ELSE '' END, '' ORDER BY x.a) AS h FROM d JOIN edges x ON d.doc_id = x.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(g.m, 0)::BIGINT AS n_removed, coalesce(g.c, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, sum(e - a + 1) AS m, count(*) AS c FROM spans GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""
