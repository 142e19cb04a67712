"""Operator 7: benchmark passages found by spaced seeds, in DataFrame functions alone.

A passage is a window of WINDOW words of an item that stands in a text with at most ODD words exchanged (or missing beyond its ends); of an item with
SHORT to WINDOW words, the whole item with as many exchanged; of a shorter one, the whole item word for word (and one under
ALONE words must be the whole text, as a few words occur anywhere). A seed is a fixed mask over some words that leaves the
others out. The masks are two of four equal blocks: exchanged words leave two of the blocks whole, so every passage holds
a seed, and none is missed.

All masks of a benchmark begin with the same few words, so a first, cheap join keeps the positions of the texts where
such a beginning stands; seeds are made for these alone and joined with those of the benchmark. Around a hit, the windows
that hold the seed are compared word by word (by 64-bit hashes) at the same alignment; a hit takes the few words around it along, not its text. Seeds of a
small benchmark (they are counted) are broadcast; for a larger one positions alone are shuffled first. Both ways give the same rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, ODD, SHORT, ALONE = 13, 2, 9, 4
#: Words before a seed that a window which holds it may begin at.
BEFORE = WINDOW - 1
#: Fixed masks, the positions compared: blocks of three words for items of twelve words or more, of two words for others from
#: SHORT. Equal distances between blocks are one mask.
LONG_MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7))
#: Most seeds that are broadcast.
BROADCAST_SEEDS = 1_000_000

# Explodes are outer ones, as Spark tests the array of an inner one for emptiness first, which computes it again.


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _masks(sizes: list[int]) -> list[tuple[int, tuple, int, int]]:
    """(number, mask, least and most words of the items it is for) for items of these sizes."""
    out = [(k, m, 12, 1 << 30) for k, m in enumerate(LONG_MASKS) if any(x >= 12 for x in sizes)]
    out += [(10 + k, m, SHORT, 11) for k, m in enumerate(SHORT_MASKS) if any(SHORT <= x < 12 for x in sizes)]
    return out + [(20 + x, tuple(range(x)), x, x) for x in sizes if x < SHORT]


def _positions(n: Column, span: int) -> Column:
    return F.when(n >= span, F.sequence(F.lit(0), F.greatest(n - span, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _seed(k: int, mask: tuple, hashes: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(hashes, at + j) for j in mask))


def _lead(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(size)))


def _matches(near: Column, doc_size: Column, item: Column, at: Column, item_at: Column, span: Column) -> Column:
    """Where the item's windows begin that hold the seed and stand in the text at the same alignment; near: hashes of the text's words from BEFORE words before the seed on."""
    n = F.size(item)
    size, allowed = F.least(F.lit(WINDOW), n), F.when(n < SHORT, 0).otherwise(ODD)
    first, last = F.greatest(item_at + span - size, F.lit(0)), F.least(item_at, n - size)
    base = F.greatest(at - BEFORE, F.lit(0))

    def same(start: Column) -> Column:
        begin = start + at - item_at
        equal = F.filter(F.sequence(F.lit(0), size - 1), lambda j: (begin + j >= 0) & F.get(near, F.greatest(begin + j - base, F.lit(0))).eqNullSafe(F.get(item, start + j)))
        return (F.size(equal) >= size - allowed) & ((n >= ALONE) | (doc_size == n))

    return F.filter(F.sequence(first, last), same)


def passages(docs: DataFrame, benchmark: DataFrame, key: list[str], text: str = "text", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(*key, item, item_start, start, size): every passage of an item (named by a hash of its words) in the texts, once; starts count words.

    key: columns that name a text; rows that share them all must have equal texts, and count as one. Null texts and
    items hold no words. An empty benchmark, or one without words, is found nowhere.
    """
    items = benchmark.select(_words(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0).distinct().withColumn("item", F.xxhash64("item_words"))
    masks = _masks(sorted(r[0] for r in items.select(F.least(F.size("item_words"), F.lit(12)).alias("n")).distinct().collect()))
    texts = docs.select(*key, _words(F.col(text)).alias("words"))
    if not masks:
        return texts.select(*key, *(F.lit(0).cast(t).alias(c) for c, t in (("item", "long"), ("item_start", "int"), ("start", "int"), ("size", "int")))).limit(0)
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    lead = min(next((i for i, j in enumerate(m) if i != j), len(m)) for _, m, _, _ in masks)
    n = F.size("item_words")

    def own(k: int, mask: tuple, low: int, high: int) -> Column:
        def seed(i: Column) -> Column:
            return F.struct(_seed(k, mask, F.col("hashes"), i).alias("seed"), _lead(F.col("hashes"), i, lead).alias("lead"), i.alias("item_at"), F.lit(mask[-1] + 1).alias("span"))

        return F.when(n.between(low, high), F.transform(_positions(n, mask[-1] + 1), seed))

    some = F.array().cast("array<struct<seed:bigint,lead:bigint,item_at:int,span:int>>")
    known = items.withColumn("hashes", hashed("item_words")).select("item", F.explode_outer(F.flatten(F.array(*(F.coalesce(own(*m), some) for m in masks)))).alias("x")).select("item", "x.*").where("seed IS NOT NULL")
    small = known.limit(broadcast_seeds + 1).count() <= broadcast_seeds  # which bounds the items' words too
    bounded = F.broadcast if small else lambda df: df
    leads = lambda df, *more: df.select(*key, *more, F.posexplode_outer(F.transform(_positions(F.size("hashes"), lead), lambda i: _lead(F.col("hashes"), i, lead))).alias("at", "lead"))
    texts = texts.withColumn("hashes", hashed("words")).drop("words")
    if small:
        begins = leads(texts, "hashes").join(F.broadcast(known.select("lead").distinct()), "lead", "left_semi")
    else:  # positions alone are shuffled to the leads, and those that are left come back to their text
        some = leads(texts).join(known.select("lead").distinct(), "lead", "left_semi").groupBy(*(F.col(c).alias(f"_of_{c}") for c in key)).agg(F.collect_set("at").alias("ats"))
        named = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key]
        begins = texts.dropDuplicates(key).join(some, named).select(*key, "hashes", F.explode_outer("ats").alias("at"))
    around = F.slice("hashes", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, WINDOW + BEFORE)
    begins = begins.select(*key, "at", F.size("hashes").alias("doc_size"), F.array(*(F.when(F.col("at") + m[-1] < F.size("hashes"), _seed(k, m, F.col("hashes"), F.col("at"))) for k, m, _, _ in masks)).alias("seeds"), around.alias("near"))
    hits = begins.select(*key, "at", "doc_size", "near", F.explode_outer("seeds").alias("seed")).join(bounded(known.drop("lead")), "seed")
    found = hits.join(bounded(items.select("item", hashed("item_words").alias("item_hashes"))), "item")
    windows = _matches(F.col("near"), F.col("doc_size"), F.col("item_hashes"), F.col("at"), F.col("item_at"), F.col("span"))
    found = found.select(*key, "item", (F.col("at") - F.col("item_at")).alias("shift"), F.least(F.lit(WINDOW), F.size("item_hashes")).alias("size"), F.explode_outer(windows).alias("item_start"))
    return found.where("item_start IS NOT NULL").select(*key, "item", "item_start", (F.col("item_start") + F.col("shift")).alias("start"), "size").distinct()


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("_leak_h"), F.xxhash64(F.lit(2), text).alias("_leak_g")]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word): documents that hold passages of an item, how many, and the words from the first to the last (beyond the ends where the text cuts a passage short).

    Rows that repeat id and text are one document; of rows that share the id alone, each text counts. Rows with a null id
    are reported under it. Items of equal words are each reported, with a null id too.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *_text_key(F.col(text)))
    found = passages(rows, benchmark, ["doc_id", "_leak_h", "_leak_g"], "text", item_text, broadcast_seeds)
    names = benchmark.select(F.col(item_id).alias("item_id"), F.xxhash64(_words(F.col(item_text))).alias("item")).distinct()
    by = found.groupBy("doc_id", "_leak_h", "_leak_g", "item").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max(F.col("start") + F.col("size") - 1).alias("last"))
    return by.join(names, "item").groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_windows"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows, with all their columns, whose text holds no passage of the benchmark, whatever their id."""
    rows = docs.select(F.col(text).alias("text"), *_text_key(F.col(text)))
    found = passages(rows, benchmark, ["_leak_h", "_leak_g"], "text", broadcast_seeds=broadcast_seeds).select("_leak_h", "_leak_g").distinct()
    return docs.select(F.struct(*docs.columns).alias("_doc"), *_text_key(F.col(text))).join(found, ["_leak_h", "_leak_g"], "left_anti").select("_doc.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}"


# Without seeds: equal words give alignments, and every window is compared at those with enough of them.
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, * FROM (SELECT DISTINCT * FROM ({_words_sql('documents', 'doc_id, text')}))),
b AS (SELECT row_number() OVER () AS b, len(w) AS n, least({WINDOW}, len(w)) AS size, CASE WHEN len(w) < {SHORT} THEN 0 ELSE {ODD} END AS odd, * FROM (SELECT DISTINCT * FROM ({_words_sql('benchmark', 'item_id')}) WHERE len(w) > 0)),
dw AS (SELECT d, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT b, size - odd AS least, unnest(w) AS x, unnest(range(len(w))) AS p FROM b),
aligned AS (SELECT d, b, dw.p - bw.p AS shift, least FROM dw JOIN bw ON dw.x = bw.x GROUP BY ALL HAVING count(*) >= least),
starts AS (SELECT d.doc_id, b.item_id, d.w AS dw, b.w AS bw, n, size, odd, shift, unnest(range(n - size + 1)) AS s FROM aligned JOIN d USING (d) JOIN b USING (b)),
good AS (
  SELECT doc_id, item_id, s + shift AS a, size FROM starts
  WHERE (n >= {ALONE} OR len(dw) = n)
    AND len(list_filter(range(size), lambda j: s + shift + j >= 0 AND dw[greatest(s + shift + j, 0) + 1] = bw[s + j + 1])) >= size - odd
)
SELECT doc_id, item_id, count(*)::BIGINT AS n_windows, min(a)::BIGINT AS first_word, max(a + size - 1)::BIGINT AS last_word FROM good GROUP BY doc_id, item_id
"""
