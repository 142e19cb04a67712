"""Operator 13: quality by naive Bayes support vectors.

A text is a set of n-grams: of its words, and of the classes of its words (case, punctuation at their ends, length, and whether
a word repeats the one before), so that junk is known by its form where its words were never seen. N-grams are hashed; each has the
logarithm of its share of the n-grams of good texts over its share of those of bad ones, and a text is the vector of these ratios, of unit
length. A linear classifier is fitted on a bounded sample by dual coordinate descent on the hinge loss, weights of the
rarer class being raised; a logistic curve through the margins of texts that it was not fitted on gives the score.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATED, Words, fold, mix, pieces, staged, text_bytes

#: Labelled documents of each class that are learnt from at most, picked by a hash of the id.
SAMPLE = 4000
#: N-grams that have a weight at most: those whose shares of good and bad texts differ most for their number.
FEATURES = 1 << 15
BITS = 20
#: N-grams of words, and of classes of words.
WORDS, CLASSES = (1, 2), (1, 2, 3)
#: Added to counts; cost of the hinge loss; passes over the sample; change of all multipliers at which descent ends.
ALPHA, COST, PASSES, TOLERANCE = 1.0, 1.0, 60, 1e-3
#: One in so many texts of the sample (by a hash of the text) isn't fitted on but places the curve.
HELD = 5
#: Tasks that the sample is dealt to.
TASKS = 6


def _classes(words: Words, raw: np.ndarray) -> np.ndarray:
    """The class of each word, as a hash."""
    s, e = words.start, words.end
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[e] - total[s]

    high = (raw >= 65) & (raw <= 90)
    upper, lower = count(high), count((raw >= 97) & (raw <= 122))
    case = np.select([upper + lower == 0, upper == 0, (upper == 1) & high[s], lower == 0], [0, 1, 2, 3], 4)
    sign = lambda at, ok: np.where(ok & PUNCTUATED[raw[at]], raw[at], 0).astype(np.uint64)
    ends, ok = [], np.ones(len(s), bool)
    for k in (1, 2, 3):
        ends.append(sign(np.maximum(e - k, s), ok & (size >= k)))
        ok = ends[-1] > 0
    same = np.append(False, words.hash[1:] == words.hash[:-1])
    same[words.of[:-1][words.of[:-1] < words.of[1:]]] = False  # a text's first word repeats none
    out = np.zeros(len(s), np.uint64)
    for x in (case, *ends, sign(s, True), same, np.minimum(np.log2(size).astype(np.int64), 6), count((raw >= 48) & (raw <= 57)) > 0):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(x).astype(np.uint64) + np.uint64(1))
    return out


def _grams(texts: pa.Array):
    """(text, bucket) of every n-gram, kind by kind; repeats included."""
    words, (raw, _) = Words(texts), text_bytes(texts)
    n = np.diff(words.of)
    of, left = np.repeat(np.arange(len(n)), n), np.repeat(words.of[1:], n) - np.arange(len(words.hash))  # words from here to the text's end
    for unit, sizes in ((words.hash, WORDS), (_classes(words, raw), CLASSES)):
        value = np.full(len(unit), len(sizes), np.uint64)
        for k in range(max(sizes)):
            value = mix(value[: len(unit) - k if k else None] * np.uint64(0x9E3779B97F4A7C15) + unit[k:]) if len(unit) > k else value[:0]
            if k + 1 in sizes:
                some = left[: len(value)] > k
                yield of[: len(value)][some], (value[some] >> np.uint64(64 - BITS)).astype(np.int64)
            value = value[: max(0, len(unit) - k - 1)]


def _sets(texts: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text, sorted; with place, of those that have one, by their place."""
    found = []
    for of, bucket in _grams(texts):
        at = bucket if place is None else place[bucket]
        keep = at >= 0
        found.append(np.unique(of[keep] << BITS | at[keep]))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _sampled(batches):
    """(good, held, grams): the sorted buckets of each text, as bytes."""
    for batch in batches:
        for piece in pieces(batch):
            of, bucket = _sets(piece.column("text"))
            ends = np.searchsorted(of, np.arange(piece.num_rows + 1))
            grams = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("good"), piece.column("held"), pa.array(grams, pa.binary())], ["good", "held", "grams"])


def _tally(batches):
    """(bucket, good, bad): texts of a task that have it."""
    n = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for good, grams in zip(batch.column("good").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            n[good, np.frombuffer(grams, "<u4")] += 1
    some = np.flatnonzero(n.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[1, some]), pa.array(n[0, some])], ["bucket", "good", "bad"])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, passes: int = PASSES) -> np.ndarray:
    """Weights (the last is the bias) of the linear classifier with the hinge loss, by dual coordinate descent: one multiplier at a time is set to its best value between 0 and its cost, in a new random order each pass."""
    w, dual = np.zeros(size + 1), np.zeros(len(y))
    square = np.array([(v * v).sum() + 1.0 for v in values])
    order = np.random.default_rng(13)
    for _ in range(passes):
        change = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(dual[i] - g / square[i], 0.0), cost[i])
            step = new - dual[i]
            if step:
                w[rows[i]] += step * y[i] * values[i]
                w[-1] += step * y[i]
                dual[i] = new
                change = max(change, abs(step) / cost[i])
        if change < TOLERANCE:
            break
    return w


def curve(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(slope, offset) of the logistic curve, by Newton's steps; targets are a little inside 0 and 1, so that it exists for classes that margins part."""
    n = [max(1.0, float(weight[good == c].sum())) for c in (0, 1)]
    target, x = np.where(good == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2)), np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (target - p)) - 1e-3 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        beta = beta + np.clip(step, -5, 5)
    return beta


def _fitted(ratio: np.ndarray, shares: tuple[float, float]):
    """The classifier and its curve, from texts as places of n-grams; shares: of bad and good texts among all that are labelled."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("held", "ascending"), ("good", "ascending"), ("grams", "ascending")])
        good, held = (table.column(c).to_numpy().astype(np.int64) for c in ("good", "held"))
        rows = [np.frombuffer(g, "<u4").astype(np.int64) for g in table.column("grams").to_pylist()]
        values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
        fit = np.flatnonzero(held == 0)
        if len(np.unique(good[fit])) < 2:
            fit = np.arange(len(good))
        n = np.bincount(good[fit], minlength=2)
        w = descend([rows[i] for i in fit], [values[i] for i in fit], 2.0 * good[fit] - 1, COST * len(fit) / (2 * n[good[fit]]), len(ratio))
        rest = np.flatnonzero(held == 1)
        if len(np.unique(good[rest])) < 2:
            rest = np.arange(len(good))
        margin = np.array([w[rows[i]] @ values[i] + w[-1] for i in rest])
        weight = np.array(shares)[good[rest]] * len(rest) / np.bincount(good[rest], minlength=2)[good[rest]]
        return pa.table({"w": [w], "curve": [curve(margin, good[rest], weight)]}, schema=pa.schema([("w", pa.list_(pa.float64())), ("curve", pa.list_(pa.float64()))]))

    return run


def _placed(place: np.ndarray):
    """The sample with places of n-grams in place of buckets."""

    def run(batches):
        for batch in batches:
            at = [place[np.frombuffer(g, "<u4")] for g in batch.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("held"), pa.array([x[x >= 0].astype("<u4").tobytes() for x in at], pa.binary())], ["good", "held", "grams"])

    return run


def _places(buckets: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))
    return place


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE, features: int = FEATURES) -> dict:
    """Fits ratios, classifier and curve on at most `sample` labelled texts of each class; rows without label or text are no use.

    Labels above 0 are good. An id with several labels has the largest, an id with several texts the one of least hash; texts that are equal count once for each label.
    Executors make and count the n-grams of the sample, one task fits at most `features` weights on it, and the driver gets those
    alone. Without labelled texts of both classes every score is the share of good labels (half, where there is none).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg((F.max("label") > 0).cast("int").alias("good"))
    totals = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    every = sum(totals.values())
    shares = tuple(totals.get(c, 0) / max(1, every) for c in (0, 1))
    picked = [known.where(F.col("good") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]  # bounded: sample
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    own = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").groupBy("id", "good").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = own.select("good", "text").distinct().withColumn("held", (F.pmod(F.xxhash64(F.lit(13), "text"), F.lit(HELD)) == 0).cast("int"))
    sets = staged(rows.repartition(TASKS).mapInArrow(_sampled, "good int, held int, grams binary"), "grams")
    n = {r["good"]: r["count"] for r in sets.groupBy("good").count().collect()}
    flat = {"buckets": np.zeros(0, np.int64), "ratio": np.zeros(0), "w": np.zeros(1), "curve": np.array([0.0, _logit(shares[1] if every else 0.5)])}
    if len(n) < 2:
        return flat
    counts = sets.mapInArrow(_tally, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = staged(counts, "counts")
    sums = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("kinds")).first()
    if not sums["kinds"]:
        return flat
    both = (F.col("good") + F.col("bad")) / (n[0] + n[1])
    apart = F.abs(F.col("good") / n[1] - F.col("bad") / n[0]) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)))
    best = counts.where("good + bad > 1").orderBy(apart.desc(), "bucket").limit(features).toArrow()  # bounded: features
    bucket, good, bad = (best.column(c).to_numpy() for c in ("bucket", "good", "bad"))
    if not len(bucket):
        return flat
    ratio = np.log((good + ALPHA) / (sums["good"] + ALPHA * sums["kinds"])) - np.log((bad + ALPHA) / (sums["bad"] + ALPHA * sums["kinds"]))
    got = sets.mapInArrow(_placed(_places(bucket)), "good int, held int, grams binary").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fitted(ratio, shares), "w array<double>, curve array<double>").first()
    return {"buckets": bucket, "ratio": ratio, "w": np.array(got["w"]), "curve": np.array(got["curve"])}


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def _scores(model: dict, place: np.ndarray, texts: pa.Array) -> np.ndarray:
    if not len(model["buckets"]):
        margin = np.zeros(len(texts))
    else:
        of, at = _sets(texts, place)
        ratio, w = model["ratio"][at], model["w"][at]
        length = np.sqrt(np.bincount(of, ratio * ratio, len(texts)))
        margin = np.bincount(of, w * ratio, len(texts)) / np.maximum(length, 1e-9) + model["w"][-1]
    slope, offset = model["curve"]
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))


def score(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row: how likely its text is good; a null text is an empty one, and whole texts are read. Scoring is a map without shuffle."""

    def run(batches):
        place = _places(model["buckets"])
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_scores(model, place, piece.column("text")))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score at least the threshold; null and empty texts are scored like any other."""

    def run(batches):
        place = _places(model["buckets"])
        for batch in batches:
            for piece in pieces(batch, text):
                yield piece.filter(pa.array(_scores(model, place, piece.column(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op13_quality(spark, sf_dir: str) -> DataFrame:
    """Score of every document; learnt from labelled rows whose crc32 modulo 3 isn't 1 (a null id counts as not 1)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
