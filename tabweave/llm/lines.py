"""Operator 2: near-duplicate lines found by a deletion-neighbourhood join, in DataFrame functions alone.

A line goes if an earlier place (doc_id, line number) holds an equal line, or, for lines of at least MIN_WORDS words,
one at an edit distance of one word: a word put in, left out or exchanged. Such lines meet at a variant: the line itself
or the line without one word, hashed (first coarsely, by sums over adjacent words; where these meet, exactly). To keep variants few, a first pass hashes the halves of every line, since lines one word
apart share their first or last half; only lines that share a half with a different line emit their variants. Lines that
meet in a variant at the same deleted position are one exchange apart from each other, so each is checked against the
earliest of them alone; so it is for a line and those that lack one of its words. No pairs of a group are formed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# Explodes are outer ones, as Spark tests the array of an inner one for emptiness first, which computes it again.

MIN_WORDS = 8


def _words(line: Column) -> Column:
    return F.split(line, " ", -1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lines(docs: DataFrame, text: str, id_col: str | Column) -> DataFrame:
    """(doc_id, pos, line, h, g): the lines that aren't blank; h and g: two hashes."""
    rows = docs.where(_col(id_col).isNotNull()).select(_col(id_col).alias("doc_id"), F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    return rows.where(F.trim("line") != "").withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def _halves(words: Column) -> Column:
    """Keys one of which any two lines one word apart share: for their own number of words and for one less, the first half and the rest."""

    def of(m: Column) -> list[Column]:
        k = F.floor(m / 2).cast("int")
        return [F.xxhash64(m, F.lit(1), F.slice(words, F.lit(1), k)), F.xxhash64(m, F.lit(2), F.slice(words, F.size(words) - (m - k) + 1, m - k))]

    n = F.size(words)
    return F.array(*of(n), *of(n - 1))


def _pair(a: Column, b: Column) -> Column:
    """44 bits, so that sums stay in range."""
    return F.shiftright(F.xxhash64(a, b), 20)


def _coarse(lines: DataFrame) -> DataFrame:
    """(place, at, key): for a line (at 0) and for the line without its word `at`, the sum of the hashes of adjacent words.

    A sum follows from the whole line's by the pairs that a word takes part in, so all variants take time in proportion to the line.
    """
    word = lambda i: F.get("words", i)  # noqa: E731  null before the first and after the last
    last = F.size("words")
    pairs = lines.withColumn("pairs", F.transform(F.sequence(F.lit(0), last), lambda i: _pair(F.when(i > 0, word(i - 1)), word(i))))
    sums = pairs.withColumn("sum", F.aggregate("pairs", F.lit(0).cast("bigint"), lambda a, x: a + x))
    less = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.col("sum") - F.get("pairs", i) - F.get("pairs", i + 1) + _pair(F.when(i > 0, word(i - 1)), word(i + 1)))
    return sums.select("place", F.posexplode_outer(F.concat(F.array("sum"), less)).alias("at", "key"))


def _one_word_apart(a: Column, b: Column) -> Column:
    """The words at both ends that are equal leave at most one."""

    def equal(x: Column, y: Column) -> Column:
        first = F.array_position(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"].eqNullSafe(p["y"])), False)
        return F.when(first == 0, F.least(F.size(x), F.size(y))).otherwise(first - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (equal(a, b) + equal(F.reverse(a), F.reverse(b)) >= longest - 1)


def removed_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, pos) of every line that goes; pos counts lines from 0. Blank lines stay, and rows without an id take no part.

    An earlier line counts even if it goes itself. Rows that repeat an id share their places: none is earlier than the
    other, and what goes at a place goes in all of them.
    """
    return _removed(docs, text, id_col, min_words).distinct()


def _removed(docs: DataFrame, text: str, id_col: str | Column, min_words: int) -> DataFrame:
    """The same, with places of rows that repeat an id more than once."""
    place = F.struct("doc_id", "pos")
    lines = _lines(docs, text, id_col)
    words = F.when(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) >= min_words - 1, _words(F.col("line")))
    hashed = staged(lines.withColumn("words", words).select("doc_id", "pos", "h", "g", F.when(F.col("words").isNotNull(), _halves(F.col("words"))).alias("keys")), "lines")
    first = hashed.groupBy("h", "g").agg(F.min(place).alias("first"))
    again = hashed.select("h", "g", place.alias("place")).join(first, ["h", "g"]).where("place != first").select("place.*")

    keys = hashed.where("keys IS NOT NULL").select("h", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("key")
    likely = keys.join(shared, "key", "left_semi").select("h").distinct().join(first.select("h", "first.*"), "h").select("doc_id", "pos")
    some = lines.join(likely, ["doc_id", "pos"]).select(place.alias("place"), _words(F.col("line")).alias("words")).distinct()
    some = staged(some, "likely")

    coarse = _coarse(some)
    met = coarse.groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low != high").select("key")
    less = F.when(F.col("at") == 0, F.col("words")).otherwise(F.concat(F.slice("words", F.lit(1), F.col("at") - 1), F.slice("words", F.col("at") + 1, F.size("words"))))
    variants = staged(coarse.join(met, "key", "left_semi").join(some, "place").select("place", "at", F.xxhash64(less).alias("v")), "variants")
    best = variants.groupBy("v", "at").agg(F.min("place").alias("other"))
    same = variants.where("at > 0").join(best, ["v", "at"])
    whole = variants.where("at = 0").join(best.where("at > 0").groupBy("v").agg(F.min("other").alias("other")), "v")
    less = variants.where("at > 0").join(best.where("at = 0").select("v", "other"), "v")
    pairs = same.select("place", "other").unionByName(whole.select("place", "other")).unionByName(less.select("place", "other")).where("other < place").distinct()
    pairs = pairs.join(some.select("place", F.col("words").alias("a")), "place").join(some.select(F.col("place").alias("other"), F.col("words").alias("b")), "other")
    near = pairs.where(_one_word_apart(F.col("a"), F.col("b"))).select("place.*")
    return again.unionByName(near)


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str | Column = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with the lines that go taken out of the text; every row and column stays, n_chars (if there) is counted anew.

    id_col: a column, or an expression of some, that orders the rows. A null text stays null; a text whose lines all go
    becomes empty. An empty table gives an empty one. Columns may have any names: a row is carried as one value.
    """
    gone = _removed(docs, text, id_col, min_words).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("pos").alias("gone"))
    joined = docs.select(_col(id_col).alias("id"), F.struct(*docs.columns).alias("doc")).join(gone, F.col("id") == F.col("of"), "left")
    old = F.col("doc")[text]

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # an array of one, so that the text is split once and not for each line
    new = F.when(F.col("gone").isNull(), old).otherwise(F.transform(F.array(F.split(old, "\n", -1)), left)[0])
    out = joined.select("doc", new.alias("new"))
    put = {text: F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(put.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document (null text: empty): lines before and after, characters, and a digest of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("lines_before", F.size(F.split("text", "\n", -1)).cast("long"))
    out = dedup_lines(docs)
    left = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return out.select("doc_id", "lines_before", left.alias("lines_after"), F.length("text").cast("long").alias("chars_after"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL)
), solid AS (
  SELECT (doc_id, pos) AS place, line, string_split(line, ' ') AS w FROM lines WHERE trim(line, ' ') <> ''
), firsts AS (
  SELECT line, any_value(w) AS w, min(place) AS place FROM solid GROUP BY line
), variants AS (
  SELECT place, 0 AS d, line AS v FROM firsts WHERE len(w) >= {MIN_WORDS}
  UNION ALL
  SELECT place, unnest(range(1, len(w) + 1)),
         unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ')))
  FROM firsts WHERE len(w) >= {MIN_WORDS}
), near AS (
  SELECT DISTINCT a.place FROM variants a JOIN variants b ON a.v = b.v
  WHERE b.place < a.place AND (a.d = b.d OR a.d = 0 OR b.d = 0)
), gone AS (
  SELECT DISTINCT s.place FROM solid s JOIN firsts f ON s.line = f.line
  WHERE s.place > f.place OR f.place IN (SELECT place FROM near)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines
  WHERE (doc_id, pos) NOT IN (SELECT place FROM gone) GROUP BY doc_id
)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS lines_before,
       CASE WHEN coalesce(k.text, '') = '' THEN 0 ELSE k.n END::BIGINT AS lines_after,
       length(coalesce(k.text, ''))::BIGINT AS chars_after, md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
