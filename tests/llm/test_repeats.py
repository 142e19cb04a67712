"""Operator 8's rounds by themselves, without Spark between them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tabweave.llm import substrings as S


def piece(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([hash(str(i)) for i in range(len(texts))], pa.int64())], ["doc_id", "text", "place"])


def rounds(tmp_path, texts, bits=5):
    """Bytes that go from each text, and how many strings the second round compared."""
    compared = []
    for name, found, kinds, settle in (("runs", S._runs_of, S._RUN, S._settle_runs), ("strings", None, S._STRING, S._settle_strings)):
        if not found:
            again, one, left = (S.Sorted(f"file://{tmp_path}/runs/{x}", bits) for x in ("again", "one", "left"))
            found = S._strings_of(again, one, left)
        parts = list(S._emit(bits, found, kinds)(iter([piece(texts)])))
        rows = pa.Table.from_batches(parts, pa.schema([("shard", pa.int32()), ("payload", pa.binary())]))
        for shard in set(rows.column("shard").to_pylist()):
            settle(f"file://{tmp_path}/{name}")(rows.filter(pa.compute.equal(rows.column("shard"), shard)))
        compared.append(sum(len(x) for x in rows.column("payload").to_pylist()) // sum(np.dtype(k).itemsize for k in kinds))
    runs, strings = S.Runs(pa.array(texts)), S.Sorted(f"file://{tmp_path}/strings/again", bits)
    whole = again.has(*runs.keys)
    begin, stop = [runs.first[whole]], [runs.end[whole] + 199]
    for at, key, check in runs.strings(~whole & left.has(runs.bucket)):
        begin.append(at[strings.has(key, check)])
        stop.append(begin[-1] + 200)
    return S._without(piece(texts), runs, np.concatenate(begin), np.concatenate(stop)), compared[1]


def brute(texts):
    data, count = [t.encode() for t in texts], {}
    for b in data:
        for s in range(len(b) - 199):
            count[b[s : s + 200]] = count.get(b[s : s + 200], 0) + 1
    for b in data:
        gone = np.zeros(len(b) + 2, np.int8)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s + 1 : s + 201] = 1
        edge = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
        yield len(b), int(gone.sum()), len(edge), np.frombuffer(b, np.uint8)[gone[1:-1] == 0].tobytes(), [{"start": int(x), "end": int(y)} for x, y in edge]


@pytest.mark.parametrize("seed", range(6))
def test_rounds_by_brute_force(tmp_path, monkeypatch, seed):
    """Passages at random places, periods, and texts that are cut at places where others aren't."""
    monkeypatch.setattr(S, "CHUNK", random.Random(seed).choice([230, 700, 3000, 1 << 18]))
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefé \n") for _ in range(n))
    known = [noise(900) for _ in range(4)] + ["x" * 700, "ab" * 400, "one-line" * 90]
    texts = ["", "short"]
    for _ in range(40):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(known)
            a = r.randint(0, 500)
            parts += [noise(r.choice([0, 1, 60, 300])), p[a : a + r.randint(150, 500)]]
        texts.append("".join([*parts, noise(r.randint(0, 250))]))
    texts += [texts[5], texts[5], noise(200), known[0][:200], noise(199)]
    got, _ = rounds(tmp_path, texts)
    assert [tuple(x.values())[1:] for x in got.to_pylist()] == list(brute(texts))


def test_no_string_twice_in_a_run():
    """Where the least q-gram comes again, as in periods, another run begins: a run needs no second look for itself."""
    runs = S.Runs(pa.array(["one-line" * 300, "z" * 1000, "".join(random.Random(1).choice("abcd") for _ in range(3000)), "ab" * 250]))
    data = runs.data.tobytes()
    assert len(runs.first) and all(len({data[s : s + 200] for s in range(a, b)}) == b - a for a, b in zip(runs.first, runs.end, strict=True))


def test_copies_are_not_compared_string_by_string(tmp_path):
    """Of runs that occur again one stands for all, so copies add nothing to what is compared."""
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, ends = noise(3000), [noise(300) for _ in range(6)]
    texts = [e + passage + e[::-1] for e in ends]
    got, once = rounds(tmp_path / "a", texts)
    many, again = rounds(tmp_path / "b", texts + [passage] * 200)
    assert all(n >= 3000 for n in got.column("n_removed").to_pylist()) and many.column("n_removed").to_pylist()[6:] == [3000] * 200
    assert again <= once + 400 and once < 6 * 1200  # the passage's ends alone, not its 6 x 2800 strings


def test_a_file_is_opened_for_many_keys(tmp_path, monkeypatch):
    """Texts are looked up in every file of a table, and files are as many as there is text; at 10 GB there are still hundreds of keys for each (before: 14)."""
    r = np.random.default_rng(2)
    text = r.integers(97, 123, S.PIECE_BYTES, dtype=np.uint8).tobytes().decode()
    runs, opened = S.Runs(pa.array([text])), []
    monkeypatch.setattr(S, "mapped", lambda uri, kind: opened.append(uri) or np.zeros(0, kind))
    S.Sorted(f"file://{tmp_path}/left", S._bits(10 << 30, S.SHARD_BYTES)).has(runs.bucket)
    assert len(runs.first) > 100_000 and len(runs.first) / len(opened) > 300
