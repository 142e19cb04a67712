"""The operators against plain forms of themselves, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tabweave.llm import chat, decontaminate, lines, lm, packing, simhash, sketches, substrings, toxicity, urls
from tabweave.llm.components import components

SCHEMA = "doc_id long, text string, place string, row string, words string, h string, score string, part string"


def texts() -> list:
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    base = [" ".join(word() for _ in range(r.randint(1, 120))) + "\n" + " ".join(word() for _ in range(12)) for _ in range(20)]
    near = base[3].split(" ")
    near[5] = "other"
    return [
        *base, base[0], base[1], base[1], " ".join(near), None, "", "   \n\n\t", "One", "A\nB\nA", passage, f"x {passage} y", f"{passage}\n{passage}", "the " * 300, "ab" * 400, " ".join(word() for _ in range(6000)),
        base[2].upper(), base[4].replace("\n", "\n\n"),
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(texts())]
    return [*out, (7, out[7][1]), (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "p", "r", "w", "h", "s", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def split(text) -> list:
    return re.findall(rb"[^\x20\x09-\x0D]+", low(text))


def plain_model(train: list):
    """Counts of the words, of distinct pairs, and the probability of a word after another, from lists of words."""
    pairs = Counter(p for w in train for p in zip([b"<"] + w, w + [b">"], strict=True))
    raw, total, follow = Counter(), Counter(), Counter()
    kinds: dict = {}
    for (u, w), c in pairs.items():
        raw[w] += c
        total[u] += c
        follow[w] += 1
        kinds.setdefault(u, Counter())[min(c, 3)] += 1

    def discounts(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
            if all(0 < x <= i for i, x in enumerate(d, 1)):
                return [0, *d]
        return [0, 0.5, 1, 1.5]

    d, e = discounts(pairs.values()), discounts(follow.values())
    spread = sum(e[min(c, 3)] for c in follow.values())

    def p(u, w):
        uni = (follow[w] - e[min(follow[w], 3)] + spread / (len(raw) + 1)) / len(pairs)
        if not total[u]:
            return uni
        c = pairs[u, w]
        return (c - d[min(c, 3)] + sum(d[k] * n for k, n in kinds[u].items()) * uni) / total[u]

    return raw, pairs, p


def test_language_model(docs, rows, none):
    raw, pairs, p = plain_model([split(t) for i, t in rows if i is None or i % 3])
    assert sum(p(b"<", w) for w in raw) + p(b"<", b"never") == pytest.approx(1)
    model = lm.train(docs.where("doc_id IS NULL OR doc_id % 3 <> 0"))
    n, v = sum(raw.values()), len(raw)
    assert (model["tokens"], model["words"], model["pairs"]) == (n, v, len(pairs))
    got = sorted(map(tuple, lm.score(docs, model).select("doc_id", "n_tokens", "n_known", "base_score", "score").collect()), key=str)
    want = []
    for i, t in rows:
        w = [*split(t), b">"]
        want.append((i, len(w), sum(raw[x] > 0 for x in w), sum(math.log10((raw[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip([b"<", *w], w, strict=False))))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a == pytest.approx(b)
    empty = lm.train(none)
    assert lm.score(none, empty).count() == 0 and all(np.isfinite(r.score) for r in lm.score(docs, empty).collect())


def test_language_model_query(spark, sf):
    texts = {r.doc_id: split(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    raw, _, p = plain_model([w for i, w in texts.items() if not held[i]])
    n, v = sum(raw.values()), len(raw)
    got = {r.doc_id: r for r in lm.op1_lm_score(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, words in texts.items():
        w = [*words, b">"]
        base = sum(math.log10((raw[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(p(a, b)) for a, b in zip([b"<", *w], w, strict=False))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(raw[x] > 0 for x in w), n)
        assert (r.base_score, r.score) == pytest.approx((base, score))


def words_apart(a: list, b: list) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines(spark, docs, rows, none):
    r = random.Random(5)
    some = [[r.choice("abc") for _ in range(r.randint(7, 10))] for _ in range(60)]
    extra = [(100 + k, "\n".join(" ".join(x) for x in some[k::6])) for k in range(6)]
    every = rows + extra
    table = docs.unionByName(spark.createDataFrame([(i, t, "p", "r", "w", "h", "s", "q") for i, t in extra], SCHEMA))
    places = sorted({(i, k, x) for i, t in every if i is not None for k, x in enumerate((t or "").split("\n")) if x.strip(" ")})
    gone = {(i, k) for n, (i, k, x) in enumerate(places) if any((j, m) < (i, k) and (x == y or min(len(x.split(" ")), len(y.split(" "))) >= 8 and words_apart(x.split(" "), y.split(" "))) for j, m, y in places[:n])}
    assert {tuple(r) for r in lines.removed_lines(table).collect()} == gone
    out = lines.dedup_lines(table)
    assert out.columns == table.columns and out.count() == len(every)
    kept = {(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in every}
    assert {(r.doc_id, r.text) for r in out.collect()} == kept
    assert lines.dedup_lines(none).count() == 0


def test_chat(spark):
    r = random.Random(2)
    data = [(c, t, ("user", "assistant")[t % 2], " ".join("word" for _ in range((3, 40)[t % 2] + r.randint(0, 2))) + ("?" if t % 2 == 0 else ".")) for c in range(30) for t in range(r.randint(1, 9))]
    long = [(99, t, ("user", "assistant")[t % 2], "word " * (3, 40)[t % 2]) for t in range(900)]
    turns = spark.createDataFrame(data + long, "conv_id long, turn long, role string, text string")
    model = chat.train(turns.where("conv_id < 20"))
    got = {(x.conv_id, x.turn): x.role for x in chat.recover(turns.drop("role"), model).collect()}
    assert got == {(c, t): role for c, t, role, _ in data + long}  # over several chunks too
    odd = spark.createDataFrame([(1, 0, "User: hello"), (1, 1, "Assistant: well"), (1, 1, "Assistant: well"), (2, None, None), (None, 3, ""), (None, 3, "**System:** be brief")], "conv_id long, turn long, text string")
    rows = chat.recover(odd, model).collect()
    assert len(rows) == 6 and {(x.conv_id, x.role, x.content) for x in rows if x.conv_id == 1} == {(1, "user", "hello"), (1, "assistant", "well")}
    assert chat.recover(odd.limit(0), model).count() == 0 and chat.recover(odd, chat.train(turns.limit(0))).count() == 6
    assert chat.transcript_steps(spark.createDataFrame([(1, "User: a\n\nBot: b"), (2, None)], "doc_id long, text string")).count() == 2
    raw = chat.transcript_steps(spark.createDataFrame([(1, "User: a?\nUser: b?\nAssistant: c\nUser: d")], "doc_id long, text string"))
    merged = chat.merged_turns(chat.recover(raw, model)).orderBy("turn").collect()
    assert [(x.turn, x.role, x.content) for x in merged] == [(0, "user", "a?\nb?"), (2, "assistant", "c"), (3, "user", "d")]
    assert merged[0].rendered == "<|user|>\na?\nb?\n<|end|>\n"


def test_chat_chunks_are_bounded(spark, monkeypatch):
    r = random.Random(8)
    one = spark.createDataFrame([(None, 0, f"text {k}") for k in range(1500)] + [(4, 3, f"other {k}") for k in range(700)], "conv_id long, turn long, text string")
    cut = [(x.conv_id, x.chunk, x.n) for x in chat._chunks(one).selectExpr("conv_id", "chunk", "size(steps) AS n").collect()]
    assert max(n for *_, n in cut) <= chat.CHUNK and sum(n for *_, n in cut) == 2200
    assert Counter(c for c, k, _ in cut if k == 0) == {None: 1, 4: 1}
    turns = spark.createDataFrame([(c, t, r.choice(["user", "assistant"]), "w " * r.randint(1, 12) + r.choice("?.")) for c in (None, 1, 2) for t in range(90)], "conv_id long, turn long, role string, text string")
    model = chat.train(turns)
    monkeypatch.setattr(chat, "CHUNK", 4)
    monkeypatch.setattr(chat, "JOINED", 3)
    got = {(x.conv_id, x.turn): model["roles"].index(x.role) for x in chat.recover(turns, model).collect()}
    for c in (None, 1, 2):  # ways that tie are as good
        e = chat._emissions(model, chat.features(turns.where(F.col("conv_id").eqNullSafe(c))).orderBy("turn").collect())
        way = [got[c, t] for t in range(90)]
        score = model["start"][way[0]] + sum(e[t][way[t]] for t in range(90)) + sum(model["trans"][a, b] for a, b in zip(way, way[1:], strict=False))
        assert score == pytest.approx(chat._best(model, e[1:], (model["start"] + e[0])[None])[0].max())


def test_repeated_turns_stay(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a?"), (1, 1, "assistant", "b " * 40)] * 10 + [(None, None, None, None)] * 5, "conv_id long, turn long, role string, text string")
    assert Counter((r.conv_id, r.turn) for r in chat.recover(turns, chat.train(turns)).collect()) == {(1, 0): 10, (1, 1): 10, (None, 0): 5}


def test_chat_query(spark, sf):
    """Every turn's role lies on a best way through its whole conversation, found without chunks, and is rendered."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    held = lambda c: zlib.crc32(str(c).encode()) % 5 == 0
    ids = [r.conv_id for r in turns.select("conv_id").distinct().collect()]
    model = chat.train(turns.where(F.col("conv_id").isin([c for c in ids if not held(c)])))
    got = chat.op3_chat(spark, sf).collect()
    assert len(got) == turns.count() and all(r.held_out == held(r.conv_id) for r in got)
    at = {r: i for i, r in enumerate(model["roles"])}
    way, seen = {}, {}
    for r in sorted(got, key=lambda r: r.turn):
        way.setdefault(r.conv_id, []).append(at[r.role])
        assert r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>\n")
    for r in chat.features(turns).orderBy("turn").collect():
        seen.setdefault(r.conv_id, []).append(r)
    for c, steps in seen.items():
        e = chat._emissions(model, steps)
        best = model["start"] + e[0]
        for x in e[1:]:
            best = (best[:, None] + model["trans"]).max(axis=0) + x
        w = way[c]
        score = model["start"][w[0]] + sum(e[k][r] for k, r in enumerate(w)) + sum(model["trans"][a, b] for a, b in zip(w, w[1:], strict=False))
        assert score == pytest.approx(best.max())
    role = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    right = [r.role == role[r.conv_id, r.turn] for r in got if r.held_out]
    assert sum(right) >= 0.7 * len(right)  # ten turns here; of larger tables the README tells


def test_viterbi_is_best(spark):
    model = {"roles": ["a", "b"], "start": np.log([0.6, 0.4]), "trans": np.log([[0.3, 0.7], [0.6, 0.4]])}
    scores = np.log(np.random.default_rng(1).random((6, 2)))
    end, _ = chat._best(model, scores[1:], (model["start"] + scores[0])[None])
    best = max(model["start"][s[0]] + sum(scores[k, s[k]] for k in range(6)) + sum(model["trans"][s[k], s[k + 1]] for k in range(5)) for s in np.ndindex(*(2,) * 6))
    assert end.max() == pytest.approx(best)


def fingerprint(text, size=4) -> int:
    w = split(text)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, none):
    got = simhash.classes(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((i, fingerprint(t)) for i, t in rows)
    group = {f: f for f in {fingerprint(t) for _, t in rows}}
    for _ in group:
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[fingerprint(t)]] = min(least.get(group[fingerprint(t)], i), i)
    assert all(r.component_id == least.get(group[r.fp % 2**64]) for r in got)
    assert simhash.classes(none).count() == 0


def test_simhash_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    group = dict.fromkeys(prints)
    for i in sorted(prints):  # smallest first, each taking all it reaches
        reached = [i] if group[i] is None else []
        for a in reached:
            group[a] = i
            more = [b for b in prints if group[b] is None and (prints[a] ^ prints[b]).bit_count() <= 4]
            for b in more:
                group[b] = i
            reached += more
    got = simhash.op4_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", group[i]) for i in prints)


def test_balls_of_a_family_are_spread():
    import pyarrow as pa

    r = np.random.default_rng(6)
    family = np.uint64(0x5A5A << 48) | r.integers(0, 2**48, 400, dtype=np.uint64)
    size = Counter()
    for batch in simhash.spread(simhash._of_prints(simhash._ball), len(simhash.BALL), 10, "fp", "fp", 1)([pa.record_batch({"fp": family.view(np.int64)})]):
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            size[bucket] += len(payload) // 12
    assert sum(size.values()) >= 400 * len(simhash.BALL) and max(size.values()) < 2 * sum(size.values()) / 1024


def test_a_key_of_all_takes_little_room():
    import pyarrow as pa

    items = pa.record_batch({"fp": np.arange(5000)})
    out = list(simhash.spread(lambda column: np.full((len(column), 3), 7, np.uint64), 3, 4, "fp", "fp", 1)([items]))
    pairs = simhash.met(pa.Table.from_batches(out), 1)
    assert sum(int(np.frombuffer(x, np.uint64, 1)[0]) for b in out for x in b.column("payload").to_pylist()) == len(out)
    assert sorted(map(tuple, pairs.T.tolist())) == [(i, 0) for i in range(1, 5000)]


def test_simhash_links_random_prints(spark):
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(150)}
    for x in list(prints):
        for k in (1, 3, 4, 5):
            for b in r.sample(range(64), k):
                x ^= 1 << b
            prints.add(x)
    table = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    parts = components(simhash.links(table)).groupBy("component").agg(F.collect_set("node").alias("n")).collect()
    group = {x: x for x in prints}
    change = True
    while change:
        change = False
        for a in prints:
            for b in prints:
                if group[a] > group[b] and (a ^ b).bit_count() <= 4:
                    group[a], change = group[b], True
    want: dict = {}
    for x, g in group.items():
        want.setdefault(g, set()).add(x)
    assert {frozenset(x % 2**64 for x in p.n) for p in parts} == {frozenset(s) for s in want.values() if len(s) > 1}


def jaccard(a, b) -> float:
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (split(a), split(b)))
    return len(a & b) / len(a | b)


def test_near_copies(spark, docs, rows, none):
    from tabweave.llm import near

    r = random.Random(11)
    base = [[f"{k}w{r.randint(0, 9999)}" for _ in range(200)] for k in range(120)]
    data = []
    for k, w in enumerate(base):
        data.append((2 * k, " ".join(w)))
        for at in r.sample(range(200), 1 + k % 8):
            w[at] = "other"
        data.append((2 * k + 1, " ".join(w)))
    table = spark.createDataFrame(data, "doc_id long, text string")
    like = [jaccard(data[2 * k][1], data[2 * k + 1][1]) for k in range(120)]
    assert sum(x >= 0.8 for x in like) > 30 and sum(x < 0.8 for x in like) > 30
    kept = {x.doc_id for x in near.near_dedup(table).collect()}
    assert kept == {2 * k for k in range(120)} | {2 * k + 1 for k in range(120) if like[k] < 0.8}
    same = spark.createDataFrame([(5, "a b c d e f g"), (5, "h i j k l m n"), (9, "A b c d e  f g"), (None, "h i j k l m n"), (None, "o p q r s t u"), (None, "o p q r s t u"), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, near.near_dedup(same).collect()), key=str) == [(3, ""), (5, "a b c d e f g"), (5, "h i j k l m n"), (None, "o p q r s t u")]
    assert near.near_dedup(docs).columns == docs.columns and near.near_dedup(none).count() == 0


def test_families_of_near_copies(spark):
    """Of each family, whose members are each near the first but not all near each other, one stays."""
    from tabweave.llm import near

    r = random.Random(12)
    data = []
    for size in (4, 20, 400):
        base = [f"{size}w{r.randint(0, 9999)}" for _ in range(200)]
        for k in range(size):
            w = list(base)
            for at in r.sample(range(200), min(k, 1 + k % 3)):
                w[at] = f"x{r.randint(0, 999)}"
            data.append((len(data), " ".join(w)))
    table = spark.createDataFrame(data, "doc_id long, text string")
    assert {x.doc_id for x in near.near_dedup(table).collect()} == {0, 4, 24}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_marginals():
    r = np.random.default_rng(1)
    of, trans = np.array([0, 3, 3, 150, 151]), r.normal(size=(2, 2))
    unary = r.normal(size=151)
    got = toxicity.marginals(unary, trans, of)
    for a, b in zip(of[:-1], of[1:], strict=True):
        if a == b:
            continue
        e = np.stack([np.ones(b - a), np.exp(unary[a:b])], axis=1)
        forward, back = [e[0]], [np.ones(2)]  # no move into the first token
        for k in range(1, b - a):
            m = forward[-1] @ np.exp(trans) * e[k]
            forward.append(m / m.sum())
        for k in range(b - a - 1, 0, -1):
            m = np.exp(trans) @ (e[k] * back[-1])
            back.append(m / m.sum())
        both = np.array(forward) * np.array(back[::-1])
        assert got[a:b] == pytest.approx(both[:, 1] / both.sum(1))


def test_field_gradient():
    """The gradient is that of the likelihood: differences of it, each path's score being summed by itself."""
    r = np.random.default_rng(2)
    of, feats = np.array([0, 5, 5, 6, 11]), r.integers(0, 4, size=(2, 11))
    y = r.integers(0, 2, 11).astype(float)

    def likelihood(x):
        w, bias, trans = x[:4], x[4], x[5:].reshape(2, 2)
        unary, out = bias + w[feats].sum(0), 0.0
        for a, b in zip(of[:-1], of[1:], strict=True):
            score = lambda path, a=a, b=b: sum(u * s for u, s in zip(unary[a:b], path, strict=True)) + sum(trans[i, j] for i, j in zip(path, path[1:], strict=False))
            out += score(y[a:b].astype(int).tolist()) - math.log(sum(math.exp(score([k >> i & 1 for i in range(b - a)])) for k in range(1 << b - a)))
        return out

    x = r.normal(size=9)
    gw, gb, gt = toxicity.gradient(x[:4], x[4], x[5:].reshape(2, 2), feats, of, y)
    step = 1e-6 * np.eye(9)
    assert np.concatenate([gw, [gb], gt.ravel()]) == pytest.approx([(likelihood(x + s) - likelihood(x - s)) / 2e-6 for s in step], abs=1e-5)


def test_toxicity_query(spark):
    """Every document once, folds as asked for, learnt from the other folds alone, and held-out labels told."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = toxicity.op5_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert all(0 <= s.start < s.end <= len(docs[r.doc_id]) and not docs[r.doc_id][s.start : s.end].isspace() for r in got for s in r.spans)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert held and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_toxicity(spark, docs, none):
    r = random.Random(1)
    make = lambda bad: " ".join(r.choice(["vile", "foul", "nasty"]) + "," if bad and r.random() < 0.1 else f"w{r.randint(0, 300)}" for _ in range(80))
    data = [(i, make(i % 4 == 0), i % 4 == 0) for i in range(400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data if i < 240] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = {x.doc_id: x for x in toxicity.tag(table, model).collect()}
    held = [i for i in range(240, 400)]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    found = [data[i][1][s.start : s.end] for i in held for s in got[i].spans]
    assert found and set(found) <= {"vile", "foul", "nasty"}
    assert sorted(x.doc_id for x in toxicity.keep_clean(table, model).collect()) == sorted(i for i in got if got[i].score < 0.5)
    odd = toxicity.tag(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.tag(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    """Beyond the bound on tokens, documents are left out whole, longer ones first, for each class; one of each stays."""
    rows = [(i, float(bad), p, min(4096, n - 4096 * p)) for i, (bad, n) in enumerate([(0, 100), (0, 5000), (0, 50), (0, 40_000), (1, 9000), (1, 70_000), (1, 20_000)]) for p in range(-(-n // 4096))]
    segments = spark.createDataFrame([(*x, b"") for x in rows], "id long, toxic double, part long, n long, feats binary")
    for tokens, want in ((10_400, {0, 1, 2, 4}), (10, {2, 4}), (10**6, set(range(7))), (60_000, {0, 1, 2, 4, 6})):
        got = toxicity._within(segments, tokens).collect()
        assert {x.id for x in got} == want and len(got) == sum(x[0] in want for x in rows)


def test_toxicity_of_a_rare_language(spark):
    r = random.Random(4)

    def make(k, bad):  # one document in fifty is in a language of its own words
        kind, bads = ("q", ["zlovo", "grdno"]) if k % 50 < 1 else ("w", ["vile", "foul"])
        return " ".join(r.choice(bads) if bad and r.random() < 0.08 else f"{kind}{r.randint(0, 300)}" for _ in range(80))

    data = [(i, make(i // 2, i % 2), i % 2) for i in range(2400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 1600], "doc_id long, toxic int")
    score = {x.doc_id: x.score for x in toxicity.tag(table, toxicity.train(table, labels)).collect()}
    held = [i for i in range(1600, 2400)]
    for some in ([i for i in held if i // 2 % 50 < 1], held):
        assert sum((score[i] >= 0.5) == data[i][2] for i in some) >= 0.95 * len(some)


def assert_packed(texts: list, got: list, length: int) -> None:
    """Each id of each text, by the tokenizer file itself, lies in one piece, and sequences are full but for the last."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, have = Counter(), Counter()
    pieces: dict = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        have[r["doc_id"]] += r["length"]
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in pieces[i, len(ids)] if r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())]
        assert sum(r["length"] for r in mine) >= len(ids)
        want[i] += len(ids)
    assert have == want
    at = 0
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in got):
        assert (s, o) == divmod(at, length) and o + n <= length
        at += n


def test_packing(spark, docs, rows, none):
    assert_packed(rows, [r.asDict() for r in packing.pack(docs, length=64).collect()], 64)
    special = [(i, t) for i, t in enumerate(["end of one <|endoftext|> start of next", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|", "<|other|> x"])]
    got = packing.pack(spark.createDataFrame(special, "doc_id long, text string"), length=8).collect()
    assert_packed(special, [r.asDict() for r in got], 8)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x  " + "\u3000" * packing.RUN + "word" + " \n" * packing.RUN + "<|endoftext|>" + "\t" * packing.RUN + "<|endoftext|> b" + " " * packing.RUN, "a" + "\x1c" * packing.RUN + "b" + " " * (packing.RUN - 1) + "c"])
def test_long_runs_of_one_character(text):
    """Ids equal those of the tokenizer file where the pattern alone gives up."""
    path, file = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    assert np.array_equal(packing.token_ids(text, path, packing.added_tokens(file)), tokenizers.Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids)


def test_packing_of_a_text_of_breaks(spark):
    got = packing.pack(spark.createDataFrame([(1, "\n" * 1_200_000), (2, "a"), (3, " " * 1_200_000)], "doc_id long, text string"))
    assert {r.doc_id: (r.n, r.d) for r in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()} == {1: (600_001,) * 2, 2: (2, 2), 3: (1_200_001,) * 2}


def test_packing_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert_packed(texts, [r.asDict() for r in packing.op6_packing(spark, sf).collect()], 1024)


def test_hilbert_steps():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1)
    key = packing.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    path = side[:, np.argsort(key)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_decontaminate(spark, docs, none):
    r = random.Random(9)
    item = [f"t{r.randint(0, 999)}" for _ in range(30)]
    other = [f"u{r.randint(0, 999)}" for _ in range(11)]
    changed = list(item)
    for k in (6, 13, 20, 27):
        changed[k] = "zz"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "too short"), (4, None), (None, "")], "item_id long, text string")
    cases = [(1000, "a b " + " ".join(changed) + " c"), (1001, " ".join(item[8:22]).upper() + "!"), (1002, " ".join(item[:8])), (1003, " ".join(reversed(item))), (1004, " ".join(other)), (1005, "too short"), (1006, " ".join(item) + " , " + " ".join(item))]
    table = docs.unionByName(spark.createDataFrame([(i, t, "p", "r", "w", "h", "s", "q") for i, t in cases], SCHEMA))
    for most in (decontaminate.BROADCAST_SEEDS, 3):
        found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(table, bench, broadcast_seeds=most).collect()}
        assert found == {(1000, 1), (1001, 1), (1004, 2), (1005, 3), (1006, 1)}
    clean = decontaminate.decontaminate(table, bench)
    assert clean.count() == table.count() - 5 and clean.columns == table.columns
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(table, bench.limit(0)).count() == 0


def test_decontaminate_misses_nothing(spark):
    from itertools import combinations

    bench = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (2, 5, 8, 9, 10, 11, 12, 13, 20)], "item_id long, text string")
    data = []
    for n in (2, 5, 8, 9, 10, 11, 12, 13, 20):
        size = min(n, 13)
        for first in {0, n - size}:
            for gone in [c for k in range(4) for c in combinations(range(size), k)]:
                w = [f"i{n}w{first + k}" for k in range(size)]
                for k in gone:
                    w[k] = "zz"
                leak = len(gone) <= (2 if n >= 9 else 0)
                data.append((None if len(data) % 3 else 7, " ".join(w if n < 4 else ["aa", *w, "bb"]), leak))
    data.append((7, "aa i2w0 i2w1 bb", False))
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 3):
        kept = Counter(r.text for r in decontaminate.decontaminate(table, bench, broadcast_seeds=most).collect())
        assert kept == Counter(t for _, t, leak in data if not leak)


def test_leaks_by_either_join(spark):
    """Both joins against all windows at all places, with null and repeated ids, repeated rows, and items of all sizes."""
    r = random.Random(5)
    word = lambda: r.choice("abcdefghij") * 2
    bench = [(i if i else None, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 4, 6, 9, 10, 11, 12, 13, 14, 25))] + [(11, "cc dd"), (12, "cc dd"), (12, "cc dd"), (13, None), (14, "")]
    rows = [(None, ""), (5, None), (5, "cc dd"), (5, "cc dd")]
    for i in range(120):
        w = r.choice(bench[:11])[1].split(" ")
        a = r.randint(0, max(0, len(w) - 13))
        w = w[a : a + r.randint(1, 16)]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "zz"
        w = [word() for _ in range(r.randint(0, 3))] * (i % 2) + w + [word() for _ in range(r.randint(0, 3))] * (i % 3)
        rows += [(r.choice([None, i % 40]), " ".join(w))] * r.choice([1, 1, 2])
    want: dict = {}
    for i, t in {(i, t or "") for i, t in rows}:
        doc = t.split()
        for k, text in set(bench):
            item = (text or "").split()
            size = min(13, len(item))
            for s in range(len(item) - size + 1 if item else 0):
                for p in range(-2, len(doc)):
                    odd = sum(not 0 <= p + j < len(doc) or doc[p + j] != item[s + j] for j in range(size))
                    if odd <= (2 if len(item) >= 9 else 0) and (len(item) >= 4 or len(item) == len(doc)):
                        n, low, high = want.get((i, k), (0, p, 0))
                        want[i, k] = (n + 1, min(low, p), max(high, p + size - 1))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert len(want) > 20
    for most in (decontaminate.BROADCAST_SEEDS, 3):
        got = decontaminate.leaks(docs, items, broadcast_seeds=most).collect()
        found = {(x.doc_id, x.item_id): (x.n_windows, x.first_word, x.last_word) for x in got}
        assert found == want and len(got) == len(want)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_SEEDS, 0])
def test_leaks_of_a_long_text(spark, most):
    """A text of 200,000 words, in which beginnings of items are frequent; what travels with a hit doesn't grow with the text."""
    r = random.Random(8)
    item = [f"q{i}" for i in range(30)]
    words = [w for _ in range(40_000) for w in (*item[:3], f"w{r.randrange(99)}", "z")]
    words[150_000:150_020] = [*item[5:12], "odd", *item[13:25]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(item[:3] * 50))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = [tuple(x) for x in decontaminate.leaks(docs, items, broadcast_seeds=most).collect()]
    # windows of 13 with two words off: one word before the passage beside the odd one, two after it
    assert got == [(1, 7, 11, 149_999, 150_021)]


def test_substrings(docs, rows, none):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + 200] for _, b in data for s in range(len(b) - 199))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone, [0]])) == 1).sum()), kept))
    got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted((tuple(r)[:4] + (bytes(r.kept),) for r in got), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 1000 and substrings.remove_repeats(none).count() == 0


def test_urls(spark):
    model = urls.train(urls.labelled_urls(spark))
    cases = {
        "https://cheap-pills.other.org/x": ("cheap-pills.other.org", "/x", None, "block"),
        "https://gambling-site.org": ("gambling-site.org", "", None, "block"),
        "http://roulette.io/play": ("roulette.io", "/play", None, "block"),
        "http://crypto-scam.biz": ("crypto-scam.biz", "", None, "block"),
        "http://sexcam.xyz/": ("sexcam.xyz", "/", None, "block"),
        "https://cityhall.org/events": ("cityhall.org", "/events", None, "allow"),
        "https://www.oldbooks.net": ("www.oldbooks.net", "", None, "allow"),
        "http://WWW.Example.com/en/1?q#z": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://casino-win.example.com/de/": ("casino-win.example.com", "/de/", "com/", "allow"),
        "http://library.example.net/fr/x": ("library.example.net", "/fr/x", "net/fr/", "block"),
        "http://library.example.com": ("library.example.com", "", None, "allow"),
        "x://y://z/p": ("y:", "//z/p", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(cases)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, model).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert urls.judge(pages.limit(0), model).count() == 0


def test_urls_held_out(spark):
    """Every fourth url is held out; then every fourth word with all its urls, of which the grams tell little (the share is in the README)."""
    table = urls.labelled_urls(spark).withColumn("page_id", F.xxhash64("url"))
    for held, least in ((F.pmod(F.xxhash64("url"), F.lit(4)) == 0, 0.9), (F.pmod(F.xxhash64("word"), F.lit(4)) == 0, 0.5)):
        scored = urls.judge(table.where(held), urls.train(table.where(~held)), rules=())
        right = scored.join(table, "page_id").select(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("int").alias("ok"))
        share, n = right.agg(F.avg("ok"), F.count("*")).first()
        assert n > 150 and share >= least


def test_urls_by_hand(spark, sf):
    """The query's hosts, paths, rules and verdicts, with the logistic curve from the model's weights and grams cut by hand."""
    model = urls.train(urls.labelled_urls(spark))
    tf, curve = model.stages
    weights = curve.coefficients.toArray()
    want = []
    for page_id, url in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        after = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = low(host).decode()
        grams = {f"{letter}{x[i : i + n]}" for letter, x in (("h", f"^{host}$"), ("p", path)) for n in (3, 4, 5) for i in range(len(x) - n + 1)}
        z = curve.intercept + sum(weights[i] for i in {tf.indexOf(g) for g in grams})
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0])) if fits else (None, "block" if z >= 0 else "allow")
        want.append((page_id, host, path, rule, verdict))
    got = urls.op9_urls(spark, sf).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted(want)


def test_sketches(spark, docs, rows, none):
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    ids = Counter(i for i, _ in distinct)
    got = {(r.doc_id, r.text): r for r in sketches.edited(docs).collect()}
    assert sketches.edited(docs).count() == len(rows) and set(got) == set(distinct)
    for k, (i, t) in enumerate(distinct):
        after = distinct[(k + 1) % len(distinct)][1]
        if ids[i] == 1 and ids[distinct[(k + 1) % len(distinct)][0]] == 1:
            half = len(t) // 2
            assert got[i, t].edited == t[: len(t) - half] + after[:half]
    sets = [(r.sample(range(40), r.randint(0, 25)), r.sample(range(40), r.randint(0, 25))) for r in [random.Random(s) for s in range(40)]] + [(list(range(300)), list(range(150, 500)))]
    table = spark.createDataFrame([(a, b) for a, b in sets], "a array<long>, b array<long>")
    digest = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    table = table.select("a", "b", digest("a").alias("x"), digest("b").alias("y"))
    cells = F.lit(sketches.CELLS).cast("bigint")
    out = table.select("a", "b", sketches.likeness(F.col("x"), F.col("y")).alias("like"), F.size(sketches.difference(F.col("x"), F.col("y"))).alias("n"), sketches.fingerprint(sketches.sketch(F.col("x"), cells)).alias("f"), sketches.fingerprint(sketches.sketch(F.reverse("x"), cells)).alias("g")).collect()
    for r in out:
        differ = len(set(r.a) ^ set(r.b))
        assert r.n == differ and r.f == r.g
        assert r.like == pytest.approx(1 - differ / (len(r.a) + len(r.b)) if r.a or r.b else 1)
    assert sketches.edited(none).count() == 0


def plain_digests(text) -> set:
    found = re.findall(r"\S+(?:[^\S\n]+\S+){0,31}", text, re.ASCII)
    return set(found + (re.findall(r"\S+", text, re.ASCII) if len(text) < sketches.SHORT else []))


def test_sketches_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in sketches.op10_fingerprints(spark, sf).collect()}
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1
    prints: dict = {}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(plain_digests, (t, edited, after))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((like(a, b), like(a, c)))
        for x, f in ((a, got[i].fingerprint), (b, got[i].edited_fingerprint)):
            assert prints.setdefault(frozenset(x), f) == f
    assert len(set(prints.values())) == len(prints)
    assert sum(r.near_edited > r.near_next for r in got.values()) >= 0.97 * len(got)


def test_sketches_of_long_texts(spark):
    """Paragraphs by the ten thousand: time in proportion to them, counts that have more than four digits."""
    lines = [f"line {k} of a long text" for k in range(60_000)]
    table = spark.createDataFrame([("\n".join(lines), "\n".join(lines[:59_990] + ["other"]))], "x string, y string")
    one = table.select(sketches.likeness(sketches.digests(F.col("x")), sketches.digests(F.col("y"))).alias("like"), sketches.fingerprint(sketches.sketch(sketches.digests(F.col("x")), F.lit(3).cast("bigint"))).alias("f")).first()
    assert one.like == pytest.approx(1 - 11 / 119_991) and int(one.f[8:24], 16) == 60_000


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{random.random()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert 0 < docs.count() < 200
    assert corpus_pipeline.run(spark, sf).agg(F.count_distinct("doc_id")).first()[0] == docs.count()


def test_stages_by_brute_force(spark, sf):
    """Near copies by all pairs of sets of shingles, passages by all windows, each on what the stage before keeps."""
    import corpus_pipeline

    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, split(t)) for i, t in rows.items())}
    kept, group = [], {}
    for i in sorted(rows):  # smallest first, each taking all it reaches
        if i not in group:
            kept.append(i)
            reached = [i]
            for a in reached:
                group[a] = i
                reached += [b for b in rows if b not in group and b not in reached and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(r.doc_id for r in steps["near_dedup"](spark, docs, sf).collect()) == kept
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(max(1, len(w) - 12))}
    by_word: dict = {}
    for w in windows:
        for j in range(3):  # of three places one at least is as it was
            by_word.setdefault((j, w[j]), []).append(w)

    def leaks(text: str) -> bool:
        d = [None, None, *re.findall(r"\w+", text.lower()), *[None] * 12]
        return any(sum(x != y for x, y in zip(w, d[p : p + len(w)], strict=True)) <= 2 for p in range(len(d) - 12) for j in range(3) for w in by_word.get((j, d[p + j]), []))

    clean = sorted(i for i, t in rows.items() if not leaks(t))
    assert len(clean) < len(rows) and sorted(r.doc_id for r in steps["decontaminate"](spark, docs, sf).collect()) == clean


def test_stages_go_by_row(spark, sf):
    import corpus_pipeline

    words = lambda k: " ".join(f"{k}x{i}" for i in range(30))
    data = [(1, words("a")), (1, words("b")), (2, words("b")), (None, words("a")), (None, words("c")), (None, words("c")), (0, words("a"))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, sf).collect()), key=str) == [(0, words("a")), (1, words("b")), (None, words("c"))]
    left = sorted((x.doc_id or -1, x.text) for x in corpus_pipeline.drop_lines(spark, docs, sf).collect() if x.text)
    assert left == [(-1, words("a")), (-1, words("c")), (-1, words("c")), (1, words("b"))]  # 0 is -1 here, and first


def test_stages_keep_clashing_columns(spark, sf):
    """Columns with the names that stages use themselves come out as they went in."""
    names = ["_row", "_place", "_line_gone", "_line_doc", "row", "doc", "gone", "of", "new", "id", "node", "_doc", "_leak_h"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        rows = docs.select("doc_id", *names).collect()
        assert docs.columns[-len(names) :] == names and rows, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
    assert packing.pack(docs).count()


def test_queries_match_sql(spark, sf, duck):
    from conftest import same_rows

    from tabweave.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(sql).df())


def test_digests_are_sha256(spark, sf):
    out = substrings.op8_suffix_dedup(spark, sf).where("n_removed = 0").limit(3).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and all(hashlib.sha256(text[r.doc_id].encode()).hexdigest() == r.kept_sha256 for r in out)


def test_sorted_keys_with_checks(tmp_path):
    from tabweave.llm.common import mapped, put_file

    key, check = np.array([5, 5, 5, 9], np.uint64), np.array([1, 3, 7, 0], np.uint32)
    for _ in range(2):  # a task that is run twice
        put_file(f"file://{tmp_path}/t/0", [key, check])
    found = substrings.Sorted(f"file://{tmp_path}/t", 4)
    ask = np.array([9, 5, 5, 5, 5, 6, 2**63, 9], np.uint64)
    assert found.has(ask, np.array([0, 7, 2, 3, 1, 0, 0, 1], np.uint32)).tolist() == [True, True, False, True, True, False, False, False]
    assert len(mapped(f"file://{tmp_path}/t/8", np.uint8)) == 0


def test_few_files_stay_mapped(tmp_path, monkeypatch):
    from tabweave.llm import common

    monkeypatch.setattr(common, "MAPS", 20)
    for k in range(60):
        common.put_file(f"file://{tmp_path}/m/{k}", [np.arange(k, k + 600, dtype=np.uint64)])
    for _ in range(2):
        assert all(common.mapped(f"file://{tmp_path}/m/{k}")[5] == k + 5 for k in range(60))
    with open("/proc/self/maps") as f:
        assert f.read().count(f"{tmp_path}/m/") <= 20


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tabweave.llm import common

    nowhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(nowhere)
