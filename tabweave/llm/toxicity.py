"""Operator 5: toxic spans tagged by a linear-chain conditional random field.

The labels mark documents, so tokens are labelled from a bounded sample of them: a word, or a beginning of words, is taken
for toxic where it stands in far more distinct contexts of toxic documents than of others (contexts, not documents, so that
copies of one text count once). The field has two states; a token's score comes from hashed weights of the word, its
beginnings and its neighbours. It is fitted on the sample by full-batch gradient ascent: forward-backward gives the expected
states and pairs of states. Every text is then scored whole: marginals give offending offsets, and a logistic curve over their sum, highest values and density gives the document's score.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PUNCTUATED, Words, fold, mix, pieces, staged

#: Labelled documents of each class that are learnt from at most, picked by a hash of the id.
SAMPLE = 1200
#: Tokens of these that are learnt from at most, half for each class. Documents count whole; where they are too many, longer ones
#: (by powers of two) are left out first.
TOKENS = 5_000_000
FEATURE_BITS = 19
#: Beginnings of words, in bytes, that are features beside the words: inflected forms share them.
PREFIXES = (5, 6, 7)
KINDS = 3 + len(PREFIXES)
BLOCK = 64
#: Tokens of a text that are learnt from as one chain; a longer text is several.
SEGMENT = 4096
#: Tasks that the sample is dealt to.
TASKS = 6
#: Of the weights of each kind of feature.
PENALTY = (0.02, *(0.02 for _ in PREFIXES), 2.0, 2.0)
#: A word's (or beginning's) share of contexts in toxic documents against that in others, the fewest toxic documents that have
#: it, and the greatest chance that as many would have it if toxic documents had it no more often than others, to be taken for toxic.
RATIO, DOCUMENTS, CHANCE = 8.0, 5, 1e-4


def _units(words: Words) -> list[np.ndarray]:
    """A 64-bit hash of each word, and of its beginnings; 0 where it is no longer than the beginning."""
    lens = words.end - words.start
    at = np.minimum(words.start[:, None] + np.arange(max(PREFIXES)), max(0, len(words.data) - 1))
    letters = words.data[at].astype(np.uint64) if len(lens) else np.zeros((0, max(PREFIXES)), np.uint64)
    packed = np.zeros(len(lens), np.uint64)
    out = []
    for k in range(max(PREFIXES)):
        packed = packed << np.uint64(8) | letters[:, k]
        if k + 1 in PREFIXES:
            out.append(np.where(lens > k + 1, mix(packed + np.uint64(k)), np.uint64(0)))
    return [words.hash, *out]


def _features(words: Words, units: list[np.ndarray]) -> np.ndarray:
    """Hashed features of each token: its units, the word before and the word after in the same text."""
    h, edge = words.hash, mix(np.array([7], np.uint64))[0]
    before, after = np.roll(h, 1), np.roll(h, -1)
    some = words.of[:-1][words.of[:-1] < words.of[1:]]
    before[some] = edge
    after[np.append(some[1:], len(h))[: len(some)] - 1] = edge
    shift = np.uint64(64 - FEATURE_BITS)
    return np.stack([(mix(x + np.uint64(i)) >> shift).astype(np.int32) + np.int32(i << FEATURE_BITS) for i, x in enumerate((*units, before, after))])


def _blocks(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each block of at most BLOCK tokens begins, and which block of its text it is."""
    n = np.diff(of)
    k = -(-n // BLOCK)
    rank = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(of[:-1], k) + rank * BLOCK, rank


def expectations(unary: np.ndarray, trans: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at every token of chains given by of, and the expected number of each pair of adjacent states.

    unary: the score of state 1 over state 0; trans: the score of a state (row) before another. Blocks run side by side:
    products of their 2x2 matrices give the message into each from either side, then each is walked from there.
    """
    if not len(unary):
        return unary, np.zeros((2, 2))
    start, rank = _blocks(of)
    end = np.minimum(start + BLOCK, np.repeat(of[1:], -(-np.diff(of) // BLOCK)))
    at = start + np.arange(BLOCK)[:, None]
    real = at < end
    e = np.where(real, np.exp(np.clip(unary[np.minimum(at, len(unary) - 1)], -30, 30)), 1.0)
    t = np.exp(trans)
    moved = real.copy()
    moved[0, rank == 0] = False  # no move beyond the end, nor into a chain's first token

    def ahead(k: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The message (x, y) into token k, at it."""
        m = moved[k]
        return np.where(m, x * t[0, 0] + y * t[1, 0], x), np.where(m, x * t[0, 1] + y * t[1, 1], y) * e[k]

    one = np.ones(len(start))
    a, b, c, d = one, 0 * one, 0 * one, one  # products of the blocks' matrices, by rows
    for k in range(BLOCK):
        (a, b), (c, d) = ahead(k, a, b), ahead(k, c, d)
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
    left, right = np.ones((2, len(start))), np.ones((2, len(start)))
    for r in range(1, int(rank.max()) + 1):
        i = np.flatnonzero(rank == r)
        x, y = left[:, i - 1]
        x, y = x * a[i - 1] + y * c[i - 1], x * b[i - 1] + y * d[i - 1]
        left[:, i] = x / (x + y), y / (x + y)
    tops = np.flatnonzero(np.append(rank[1:] == 0, True))
    height = np.repeat(rank[tops], np.diff(np.append(-1, tops))) - rank
    for r in range(1, int(height.max()) + 1):
        i = np.flatnonzero(height == r)
        x, y = right[:, i + 1]
        x, y = a[i + 1] * x + b[i + 1] * y, c[i + 1] * x + d[i + 1] * y
        right[:, i] = x / (x + y), y / (x + y)
    alpha = np.empty((BLOCK + 1, 2, len(start)))
    alpha[0] = left
    for k in range(BLOCK):
        x, y = ahead(k, *alpha[k])
        alpha[k + 1] = x / (x + y), y / (x + y)
    p, pairs, (x, y) = np.empty(real.shape), np.zeros((2, 2)), right
    for k in range(BLOCK - 1, -1, -1):
        u, v = alpha[k + 1]
        p[k] = v * y / (u * x + v * y)
        y = y * e[k]
        u, v = alpha[k]
        both = np.stack([u * t[0, 0] * x, u * t[0, 1] * y, v * t[1, 0] * x, v * t[1, 1] * y])
        pairs += np.where(moved[k], both / both.sum(axis=0), 0).sum(axis=1).reshape(2, 2)
        x, y = np.where(moved[k], t[0, 0] * x + t[0, 1] * y, x), np.where(moved[k], t[1, 0] * x + t[1, 1] * y, y)
        x, y = x / (x + y), y / (x + y)
    return p.T[real.T], pairs


def marginals(unary: np.ndarray, trans: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token."""
    return expectations(unary, trans, of)[0]


def gradient(w: np.ndarray, bias: float, trans: np.ndarray, feats: np.ndarray, of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the conditional log-likelihood of the states y, for the weights, the bias and the transitions: what is seen less what is expected."""
    p, pairs = expectations(bias + sum(w[f] for f in feats).astype(float), trans, of)
    inner = np.ones(len(y), bool)
    inner[of[:-1][of[:-1] < of[1:]]] = False
    at, state = np.flatnonzero(inner), y.astype(np.int64)
    seen = np.bincount(2 * state[at - 1] + state[at], minlength=4).reshape(2, 2)
    return sum(np.bincount(f, y - p, len(w)) for f in feats), float((y - p).sum()), seen - pairs


def _sums_and_tops(p: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each chain: its tokens, the expected number of toxic ones, and the two highest marginals."""
    n = np.diff(of)
    some = n > 0
    total, top, second = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    if some.any():
        begin = of[:-1][some]
        total[some], top[some] = np.add.reduceat(p, begin), np.maximum.reduceat(p, begin)
        rest = p.copy()
        peak = np.flatnonzero(p == np.repeat(top, n))
        doc = np.searchsorted(of, peak, side="right") - 1
        rest[peak[np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))]] = 0
        second[some] = np.maximum.reduceat(rest, begin)
    return n, total, top, second


def _document_features(n: np.ndarray, total: np.ndarray, top: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of each text: the logarithm of the expected number of toxic tokens, the two highest marginals and the density."""
    return np.stack([np.ones(len(n)), np.log(total + 0.02), top, second, np.log1p(1000 * total / np.maximum(n, 1))], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * beta)
    return beta


def _chance(k: np.ndarray, other: np.ndarray, toxic_total: float, total: float) -> np.ndarray:
    """The chance (exact, binomial) that of k + other documents which have a unit at least k are toxic, at the sample's share of toxic ones."""
    p, n = toxic_total / total, k + other
    logs = np.append(0.0, np.cumsum(np.log(np.arange(1, int(n.max(initial=0)) + 1))))
    out, known = np.ones(len(k)), {}
    for i in np.flatnonzero(k >= DOCUMENTS):
        a, m = int(k[i]), int(n[i])
        if (a, m) not in known:
            x = np.arange(a, m + 1)
            known[a, m] = np.exp(logs[m] - logs[x] - logs[m - x] + x * np.log(p) + (m - x) * np.log1p(-p)).sum()
        out[i] = known[a, m]
    return out


def _tokens(batches):
    """Of each text, segments of at most SEGMENT tokens: their number, tokens, hashed features, units and contexts, a row of each kind after the other."""
    for batch in batches:
        for piece in pieces(batch):
            words = Words(piece.column("text"), PUNCTUATED)
            units = _units(words)
            feats = _features(words, units)
            context = mix(words.hash ^ mix(feats[-2].astype(np.uint64)) ^ mix(feats[-1].astype(np.uint64) << np.uint64(20)))
            cuts = [(i, a, min(a + SEGMENT, hi)) for i, (lo, hi) in enumerate(zip(words.of[:-1], words.of[1:], strict=True)) for a in range(lo, max(hi, lo + 1), SEGMENT)]
            row = pa.array([c[0] for c in cuts], pa.int64())
            packed = [[x[..., a:b].tobytes() for _, a, b in cuts] for x in (feats, np.stack(units), context)]
            part, n = [(a - int(words.of[i])) // SEGMENT for i, a, _ in cuts], [int(b - a) for _, a, b in cuts]
            yield pa.RecordBatch.from_arrays([piece.column("id").take(row), piece.column("toxic").take(row), pa.array(part, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["id", "toxic", "part", "n", "feats", "units", "contexts"])


def _columns(batch: pa.RecordBatch, name: str, kind, rows: int) -> list[np.ndarray]:
    return [np.frombuffer(x, kind).reshape(rows, -1) for x in batch.column(name).to_pylist()]


def _context_rows(batches):
    """A row for each context of a segment, with the units of its word."""
    for batch in batches:
        for i, (units, context) in enumerate(zip(_columns(batch, "units", np.uint64, 1 + len(PREFIXES)), _columns(batch, "contexts", np.int64, 1), strict=True)):
            context, at = np.unique(context[0], return_index=True)
            of = pa.array(np.full(len(at), i))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, units[:, at].size + 1, len(units)), pa.int32()), pa.array(units[:, at].T.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("toxic").take(of), pa.array(context), lists], ["id", "toxic", "context", "units"])


def _telling(segments: DataFrame, kind: str, bad: float, n: int) -> list[np.ndarray]:
    """For each kind of unit, those that stand in far more distinct contexts of toxic documents than of others, and in more of them than chance would have it.

    The test is one of the unit's own counts, so a unit of a rare language or topic is judged as one of a common one is.
    A context counts once among toxic documents and once among others, for its smallest id, so that copies of one text count once.
    """
    rows = segments.mapInArrow(_context_rows, f"id {kind}, toxic double, context long, units array<long>")
    once = rows.groupBy("toxic", "context").agg(F.min("id").alias("id"), F.min("units").alias("units"))
    units = once.select("toxic", "id", F.posexplode_outer("units").alias("k", "unit")).where("unit != 0")
    of = lambda c, v: F.sum(F.when(F.col("toxic") == v, c).otherwise(0)).alias
    by_doc = units.groupBy("k", "unit", "toxic", "id").agg(F.count("*").alias("contexts"))
    counts = staged(by_doc.groupBy("k", "unit").agg(of(F.col("contexts"), 0)("others"), of(F.lit(1), 0)("clean_docs"), of(F.col("contexts"), 1)("bad"), of(F.lit(1), 1)("bad_docs")), "units")
    totals = counts.groupBy("k").agg(F.sum("others").alias("others"), F.sum("bad").alias("bad")).collect()
    share = F.coalesce(*(F.when(F.col("k") == r["k"], F.lit(max(1, r["others"]) / max(1, r["bad"]))) for r in totals), F.lit(1.0))
    some = counts.where((F.col("bad_docs") >= DOCUMENTS) & (F.col("bad") * share >= RATIO * (F.col("others") + 1))).select("k", "unit", "bad_docs", "clean_docs").toArrow()
    k, unit, having, clean = (x.to_numpy().astype(np.int64) for x in some.columns)
    sure = _chance(having, clean, bad, n) <= CHANCE
    return [np.sort(unit[sure & (k == i)].view(np.uint64)) for i in range(1 + len(PREFIXES))]


def _states(telling: list[np.ndarray]):
    """Each segment with the states of its tokens in place of their units: toxic where the document is and a unit tells so."""

    def run(batches):
        for batch in batches:
            toxic, states = batch.column("toxic").to_numpy(), []
            for i, units in enumerate(_columns(batch, "units", np.uint64, 1 + len(PREFIXES))):
                states.append((np.logical_or.reduce([np.isin(u, t) for u, t in zip(units, telling, strict=True)]) & (toxic[i] > 0)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "toxic", "part", "feats")), pa.array(states, pa.binary())], ["id", "toxic", "part", "feats", "states"])

    return run


def _fit_field(feats: np.ndarray, of: np.ndarray, y: np.ndarray, size: int, penalty: np.ndarray, steps: int = 40, rate: float = 0.3) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the penalised conditional log-likelihood; weights beyond size are held at zero. Gradients are summed over runs of chains, so that memory follows those."""
    w, all_w, m1, m2 = np.zeros(int(feats.max(initial=0)) + 1), np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
    all_w[size] = -4.0
    for step in range(1, steps + 1):
        w[:size], grad = all_w[:size], np.zeros(size + 5)
        for at in range(0, len(of) - 1, 256):
            ends = of[at : at + 257]
            gw, gb, gt = gradient(w, all_w[size], all_w[size + 1 :].reshape(2, 2), feats[:, ends[0] : ends[-1]], ends - ends[0], y[ends[0] : ends[-1]])
            grad += np.concatenate([gw[:size], [gb], gt.ravel()])
        grad[:size] -= penalty * all_w[:size]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        all_w = all_w + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return all_w[:size], float(all_w[size]), all_w[size + 1 :].reshape(2, 2)


def _fit(table: pa.Table) -> pa.Table:
    """The model, from the segments of the sample: weights of the features that occur twice or more, the rest of the field, and the curve."""
    table = table.sort_by([("id", "ascending"), ("part", "ascending")])
    feats = [np.frombuffer(x, np.int32).reshape(KINDS, -1) for x in table.column("feats").to_pylist()]
    of = np.append(0, np.cumsum([f.shape[1] for f in feats]))
    y = np.concatenate([np.frombuffer(x, bool) for x in table.column("states").to_pylist()]).astype(float)
    kinds, back, times = np.unique(np.concatenate(feats, axis=1), return_inverse=True, return_counts=True)
    used = kinds[times > 1]
    place = np.full(len(kinds), len(used), np.int32)  # those that occur once share a place without weight
    place[times > 1] = np.arange(len(used))
    feats = place[back].reshape(KINDS, -1)
    w, bias, trans = _fit_field(feats, of, y, len(used), np.asarray(PENALTY)[used >> FEATURE_BITS])
    w = np.append(w, 0.0).astype(np.float32)
    text = np.unique(pa.compute.dictionary_encode(table.column("id")).combine_chunks().indices.to_numpy(), return_index=True)[1]
    ends = np.append(of[text], of[-1])
    p = marginals(bias + sum(w[f] for f in feats).astype(float), trans, of)
    beta = _fit_curve(_document_features(*_sums_and_tops(p, ends)), table.column("toxic").to_numpy()[text])
    return pa.table({"used": [used.astype(np.int32).tobytes()], "w": [w[:-1].tobytes()], "rest": [np.concatenate([[bias], trans.ravel(), beta])]}, schema=pa.schema([("used", pa.binary()), ("w", pa.binary()), ("rest", pa.list_(pa.float64()))]))


def _some(docs: DataFrame, labels: DataFrame, text: str, id_col: str, sample: int) -> DataFrame:
    """(id, text, toxic) of the sample; of texts that share an id, the one of the least hash."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("double").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    some = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), "id").groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def _within(segments: DataFrame, tokens: int) -> DataFrame:
    """The segments of whole documents of at most so many tokens, half of each class, and one of each at least."""
    sizes = segments.groupBy("id", "toxic").agg(F.sum("n").alias("size"))  # a row for each document of the sample
    order = Window.partitionBy("toxic").orderBy(F.floor(F.log2(F.col("size") + 1)), F.xxhash64("id"), "id")
    placed = sizes.select("id", F.sum("size").over(order).alias("total"), F.row_number().over(order).alias("place"))
    return segments.join(F.broadcast(placed.where((F.col("total") <= tokens / 2) | (F.col("place") == 1)).select("id")), "id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, tokens: int = TOKENS) -> dict:
    """Fits field and curve on at most `sample` labelled documents of each class, whole ones of at most `tokens` tokens together; rows without text or label are no use.

    The sample's features are staged by the executors, and one task fits the field on them; the driver gets its weights
    alone. Without labelled rows of both classes, or without a word that tells them apart, the field is flat and every score is
    the share of toxic labels.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = staged(_some(docs, labels, text, id_col, sample), "sample")
    n, bad = rows.agg(F.count("*"), F.sum("toxic")).first()
    share = float(np.clip(bad / n, 1e-3, 1 - 1e-3)) if n else 0.01
    flat = {"used": np.zeros(0, np.int32), "w": np.zeros(0, np.float32), "bias": -4.0, "trans": np.zeros((2, 2)), "beta": np.array([np.log(share / (1 - share)), 0, 0, 0, 0.0])}
    if not n or not 0 < bad < n:
        return flat
    segments = staged(rows.repartition(TASKS).mapInArrow(_tokens, f"id {kind}, toxic double, part long, n long, feats binary, units binary, contexts binary"), "segments")
    telling = _telling(segments, kind, bad, n)
    if not any(len(t) for t in telling):
        return flat
    states = _within(segments, tokens).mapInArrow(_states(telling), f"id {kind}, toxic double, part long, feats binary, states binary")
    got = states.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit, "used binary, w binary, rest array<double>").first()
    rest = np.array(got["rest"])
    return {"used": np.frombuffer(got["used"], np.int32), "w": np.frombuffer(got["w"], np.float32), "bias": rest[0], "trans": rest[1:5].reshape(2, 2), "beta": rest[5:]}


_dense: dict[bytes, np.ndarray] = {}


def _weights(model: dict) -> np.ndarray:
    """The weights by feature, kept for the life of the worker."""
    key = model["w"].tobytes()[:4096] + model["beta"].tobytes()
    if key not in _dense:
        _dense.clear()
        _dense[key] = np.zeros(KINDS << FEATURE_BITS, np.float32)
        _dense[key][model["used"]] = model["w"]
    return _dense[key]


def _apply(model: dict, texts: pa.Array):
    words, w = Words(texts, PUNCTUATED), _weights(model)
    p = marginals(model["bias"] + sum(w[f] for f in _features(words, _units(words))).astype(float), model["trans"], words.of)
    score = 1 / (1 + np.exp(-np.clip(_document_features(*_sums_and_tops(p, words.of)) @ model["beta"], -30, 30)))
    return words, p, score


def tag(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, spans) of every row; spans: offsets in code points of tokens that are toxic rather than not. An empty table gives no row; other columns are not looked at.

    A null text is scored as an empty one.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                words, p, score = _apply(model, piece.column("text"))
                bad = np.flatnonzero(p >= 0.5)
                chars = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
                doc = np.searchsorted(words.of, bad, side="right") - 1
                base = chars[words.off[:-1]][doc] if len(bad) else bad
                spans = pa.StructArray.from_arrays([pa.array(chars[words.start[bad]] - base), pa.array(chars[words.end[bad]] - base), pa.array(p[bad])], ["start", "end", "p"])
                where = pa.array(np.searchsorted(bad, words.of), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(where, spans)], ["doc_id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:long,end:long,p:double>>")


def keep_clean(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; null and empty texts are scored like any other."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                score = _apply(model, piece.column(text))[2]
                yield piece.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document; learnt from labelled rows whose fold isn't 0 (a null id counts as not 0)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id") != 0)
    scored = tag(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
