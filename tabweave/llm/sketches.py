"""Operator 10: document fingerprints as invertible Bloom lookup sketches of paragraphs, in DataFrame functions alone.

A paragraph is a line, cut every PIECE words; a text of few characters has its words too, so that it isn't one paragraph
alone. Each distinct digest is put into three cells, one of each third of the table, of which each holds a count, the
exclusive-or of its digests and that of their checks. Cells are kept sparse, in order: entries are sorted by cell and each
cell's are summed, so a sketch takes time in proportion to its digests (and their sorting). Two sketches are subtracted cell by
cell; cells left with one digest give it away, and taking it out of its other cells frees more, until nothing is left or
none is pure. Where something is left, both sketches are made again larger: the last sizes follow from the two counts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CELLS = 15
PIECE, SHORT = 32, 400


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text; none for a null or empty one."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(rf"\S+(?:[^\S\n]+\S+){{0,{PIECE - 1}}}"), F.lit(0))
    words = F.when(F.length(text) < SHORT, F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(pieces, words), lambda x: F.xxhash64(x)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(3))


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _entries(found: Column, cells: Column) -> Column:
    """Each digest (with its count) at its cell of each third."""

    def placed(third: Column) -> Column:
        def places(x: Column) -> Column:
            at = [F.pmod(F.xxhash64(x["key"], F.lit(k)), third) + third * k for k in range(3)]
            return F.array(*(F.struct(a.alias("at"), x["n"].alias("n"), x["key"].alias("key"), x["chk"].alias("chk")) for a in at))

        return F.flatten(F.transform(F.transform(found, lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key"), _check(x["key"]).alias("chk"))), places))

    return _once(F.floor(cells / 3).cast("bigint"), placed)


def _cells(entries: Column) -> Column:
    """The entries summed by cell, in order; cells that hold nothing are left out."""

    def add(c: Column, x: Column) -> Column:
        return F.struct(x["at"].alias("at"), (c["n"] + x["n"]).alias("n"), c["key"].bitwiseXOR(x["key"]).alias("key"), c["chk"].bitwiseXOR(x["chk"]).alias("chk"))

    zero = F.lit(0).cast("bigint")
    none = F.struct((zero - 1).alias("at"), zero.alias("n"), zero.alias("key"), zero.alias("chk"))

    def summed(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["at"] != F.get(s, F.greatest(i - 2, F.lit(0)))["at"]))
        sums = _once(begins, lambda b: F.transform(b, lambda i, k: F.aggregate(F.slice(s, i, F.coalesce(F.get(b, k + 1), F.size(s) + 1) - i), none, add)))
        return F.when(F.size(s) == 0, s).otherwise(F.filter(sums, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0)))

    return _once(F.array_sort(entries), summed)


def _less(entries: Column) -> Column:
    return F.transform(entries, lambda x: F.struct(x["at"].alias("at"), (-x["n"]).alias("n"), x["key"].alias("key"), x["chk"].alias("chk")))


def _counted(found: Column) -> Column:
    return F.transform(found, lambda d: F.struct(F.lit(1).cast("bigint").alias("n"), d.alias("key")))


def sketch(found: Column, cells: Column) -> Column:
    """The cells that hold something, of so many (a multiple of three), of an array of distinct digests."""
    return _cells(_entries(_counted(found), cells))


def fingerprint(cells: Column) -> Column:
    """Cells as hex digits: place, count, digests, checks."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["at"]), 8, "0"), *(F.lpad(F.hex(c[x]), 16, "0") for x in ("n", "key", "chk")))), ""))


def peel(a: Column, b: Column, cells: Column, most: Column) -> Column:
    """The digests (n: 1 of a, -1 of b) that two sketches of so many cells differ in; null where peeling gets stuck. most: of digests that can differ.

    Entries that haven't been summed up yet do as well as sketches, as sums and differences can be taken in any order.
    """
    start = F.struct(_cells(F.concat(a, _less(b))).alias("cells"), F.array().cast("array<struct<n:bigint,key:bigint>>").alias("got"), F.lit(True).alias("more"))

    def pure(left: Column) -> Column:
        def of(n: int) -> Column:  # apart by sign, as distinct numbers are found by hash and distinct structs by comparing all
            keys = F.transform(F.filter(left, lambda c: (c["n"] == n) & (c["chk"] == _check(c["key"]))), lambda c: c["key"])
            return F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(n).cast("bigint").alias("n"), k.alias("key")))

        return F.concat(of(1), of(-1))

    def step(state: Column, _: Column) -> Column:
        def take(p: Column) -> Column:
            rest = F.when(F.size(p) == 0, state["cells"]).otherwise(_cells(F.concat(state["cells"], _less(_entries(p, cells)))))
            return F.struct(rest.alias("cells"), F.concat(state["got"], p).alias("got"), (F.size(p) > 0).alias("more"))

        return F.when(state["more"], _once(pure(state["cells"]), take)).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(0).cast("bigint"), most.cast("bigint")), start, step)  # every step but the last gives a digest
    return _once(end, lambda e: F.when(F.size(e["cells"]) == 0, e["got"]))


def difference(a: Column, b: Column, small_a: Column | None = None, small_b: Column | None = None) -> Column:
    """Digests that two arrays of distinct digests differ in, by sketches of CELLS (given, if they are there), then larger ones.

    The sizes of these follow from the counts; as cells are sparse, many of them cost no more, and leave most digests alone in one.
    null only if even the last is stuck, which takes digests that share all three of their cells.
    """
    base = F.lit(CELLS).cast("bigint")
    total = (F.size(a) + F.size(b)).cast("bigint")
    least = F.abs(F.size(a) - F.size(b))  # as many differ at least, so a sketch of fewer cells would surely fail

    def of(cells: Column) -> Column:
        return _once(cells, lambda m: peel(_entries(_counted(a), m), _entries(_counted(b), m), m, total))

    first = peel(small_a if small_a is not None else sketch(a, base), small_b if small_b is not None else sketch(b, base), base, total)
    return F.coalesce(F.when(least <= CELLS, first), of(total * 6 + CELLS), of(total * 24 + 8 * CELLS))


def likeness(a: Column, b: Column, small_a: Column | None = None, small_b: Column | None = None) -> Column:
    """1 less the share of paragraphs that differ; 1 for two empty sets."""
    total = F.size(a) + F.size(b)
    differ = F.coalesce(F.size(difference(a, b, small_a, small_b)), F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - differ / total)


def _followers(keyed: DataFrame) -> DataFrame:
    """(doc_id, h, n, for_doc, for_h, for_n): every distinct key, and the one it follows by descending doc_id (then h); the first follows the last.

    The small table is range-sorted and staged; a look at the ends of each part joins the parts.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    parts = staged(keyed.select("doc_id", "h", F.length("text").alias("n")).distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*order)
    me = F.struct("doc_id", "h", "n")
    rows = parts.select("doc_id", "h", "n", "part", F.lag(me).over(inside).alias("before"), F.row_number().over(inside).alias("rank"))
    size = parts.groupBy("part").agg(F.count("*").alias("size"))
    lasts = rows.join(size, "part").where("rank = size").select("part", me.alias("last"))
    over = Window.orderBy("part")
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = lasts.select("part", F.coalesce(F.lag("last").over(over), F.last("last").over(everything)).alias("end"))
    before = F.coalesce("before", "end")
    return rows.join(ends, "part").select("doc_id", "h", before["doc_id"].alias("for_doc"), before["h"].alias("for_h"), before["n"].alias("for_n"))


def edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, edited, next_digests): every text, itself with its last half replaced by the next document's beginning, and that one's paragraphs.

    Null texts are empty. Rows that repeat both id and text take one place in the order; of rows that share only the id,
    the texts' hashes decide. A null id comes last. A single document is its own next. An empty table gives no row; other columns
    are not looked at.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    key = ["id", "no_id", "h"]  # plain columns, so that both joins and the window share one partitioning of the texts
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_col.alias("text"), F.xxhash64(text_col).alias("h"))
    parts = lambda c: [F.coalesce(c, F.lit(0).cast(docs.schema[id_col].dataType)), c.isNull()]
    follows = _followers(keyed)
    follows = follows.select(*(c.alias(n) for c, n in zip(parts(F.col("doc_id")), key, strict=False)), "h", *(c.alias(f"for_{n}") for c, n in zip(parts(F.col("for_doc")), key, strict=False)), "for_h", "for_n")
    texts = keyed.select(*(c.alias(n) for c, n in zip(parts(F.col("doc_id")), key, strict=False)), "h", "text")  # these columns alone on both ways, so that one shuffle serves both
    rows = texts.join(follows, key)
    once = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("for_h"))).where("copy = 1")
    lent = once.select(*(F.col(f"for_{n}").alias(n) for n in key), F.substr("text", F.lit(1), F.floor(F.col("for_n") / 2).cast("int")).alias("lent"), digests(F.col("text")).alias("next_digests"))
    joined = texts.join(lent, key)
    n, doc_id = F.length("text"), F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    return joined.select(doc_id, "text", F.concat(F.substr("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "lent").alias("edited"), "next_digests")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    cells = F.lit(CELLS).cast("bigint")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), F.col("next_digests").alias("c"))
    rows = rows.withColumns({f"small_{x}": sketch(F.col(x), cells) for x in "abc"})
    a, b, c = ((F.col(x), F.col(f"small_{x}")) for x in "abc")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a[1]).alias("fingerprint"), fingerprint(b[1]).alias("edited_fingerprint"),
        likeness(a[0], b[0], a[1], b[1]).alias("near_edited"), likeness(a[0], c[0], a[1], c[1]).alias("near_next"),
    )
