"""Stores that grow over runs: keys that were seen, answers with their corrections, and rows by page.

Each is a folder of Parquet files that all machines see, laid out so that a run touches only what it needs.
"""

import json
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; a temporary one where none is named and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tabweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _put(path: str, name: str, value) -> None:
    fs, root = _file(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(json.dumps(value).encode())


def _get(path: str, name: str):
    fs, root = _file(path)
    if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{name}") as f:
        return json.loads(f.read())


class KeyStore:
    """Keys seen by earlier runs, bucketed: new rows are shuffled to them, they themselves aren't.

    The number of buckets is settled when the store is made (by default the session's shuffle partitions) and is kept in it. Keys may be null;
    a null equals no other, so rows that have one are always new.
    """

    def __init__(self, spark: SparkSession, path: str, keys: str = "hash string", buckets: int | None = None):
        about = _get(path, "_store.json")
        if about is None:
            about = {"keys": keys, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
            _put(path, "_store.json", about)
        self.spark, self.columns = spark, [c.strip().split(" ")[0] for c in about["keys"].split(",")]
        self.name = "keys_" + "".join(c if c.isalnum() else "_" for c in path.lower())
        by = ", ".join(self.columns)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{self.name}` ({about['keys']}) USING parquet CLUSTERED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
        self.buckets = about["buckets"]

    def seen(self) -> DataFrame:
        self.spark.catalog.refreshTable(f"`{self.name}`")
        return self.spark.table(f"`{self.name}`")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys no earlier run has had."""
        return rows.join(self.seen(), self.columns, "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Keeps the keys of the rows that aren't there yet: a file for each bucket and run. A run that is done again adds nothing."""
        new = self.unseen(rows.select(*self.columns).dropna("any").distinct())
        new.repartition(self.buckets, *self.columns).write.insertInto(f"`{self.name}`")


class AnswerStore:
    """Answers by question in `parts` folders (by a hash of the question), with the log of their corrections beside them.

    A correction rewrites only the folders that hold a corrected question, and adds a folder to the log, in one commit of one write.
    """

    SCHEMA = "question_id string, answer string, old string, new string, at timestamp, kind string, part long"

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path = spark, path
        self.parts = (_get(path, "_parts.json") or {"parts": parts})["parts"]

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("question_id"), F.lit(self.parts))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        columns = [c.split(" ")[0] for c in self.SCHEMA.split(", ")]
        kinds = dict(c.split(" ") for c in self.SCHEMA.split(", "))
        full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))
        full.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("kind", "part").parquet(self.path)

    def create(self, pairs: DataFrame) -> None:
        """The first version; of pairs that share a question, the greatest answer stays."""
        once = pairs.groupBy("question_id").agg(F.max("answer").alias("answer"))
        self._write(once.withColumns({"kind": F.lit("answers"), "part": self._part()}).repartition("part"), "overwrite")
        _put(self.path, "_parts.json", {"parts": self.parts})

    def answers(self) -> DataFrame:
        return self._rows().where("kind = 'answers'").select("question_id", "answer")

    def log(self) -> DataFrame:
        """(run, question_id, old, new, at) of all corrections."""
        return self._rows().where("kind = 'log'").select(F.col("part").alias("run"), "question_id", "old", "new", "at")

    def correct(self, corrected: DataFrame) -> int:
        """Takes (question_id, answer) in; questions that aren't there, and answers that are as they were, change nothing. Returns the number of the run, -1 where nothing changed."""
        new = corrected.groupBy("question_id").agg(F.max("answer").alias("new")).where("new IS NOT NULL").withColumn("part", self._part())
        touched = sorted(r[0] for r in new.select("part").distinct().collect())  # at most `parts` numbers
        own = self._rows().where(F.col("kind") == "answers").where(F.col("part").isin(touched)).select("question_id", "answer", "part")
        both = own.join(new.drop("part"), "question_id", "left").withColumn("changed", F.coalesce(~F.col("new").eqNullSafe(F.col("answer")), F.lit(False)) & F.col("new").isNotNull())
        changed = sorted(r[0] for r in both.where("changed").select("part").distinct().collect())
        if not changed:
            return -1
        last = self._rows().where("kind = 'log'").agg(F.max("part")).first()[0]
        run = 0 if last is None else last + 1
        both = both.where(F.col("part").isin(changed))
        kept = both.select("question_id", F.when(F.col("changed"), F.col("new")).otherwise(F.col("answer")).alias("answer"), F.lit("answers").alias("kind"), "part")
        said = both.where("changed").select("question_id", F.col("answer").alias("old"), "new", F.current_timestamp().alias("at"), F.lit("log").alias("kind"), F.lit(run).cast("long").alias("part"))
        self._write(kept.unionByName(said, allowMissingColumns=True).repartition("kind", "part"), "overwrite")
        return run


class Pages:
    """Rows in order, a folder for each stretch, with how many come before it: a page reads the one or two stretches that hold it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, rows: DataFrame, order: list[str], parts: int | None = None) -> None:
        """Sorts the rows over all machines. Ties of `order` fall as they come; `_part` and `_at` are the store's own columns."""
        ranged = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
        number = F.monotonically_increasing_id()  # partition, and place in it
        ranged.withColumns({"_part": F.shiftright(number, 33), "_at": number.bitwiseAND((1 << 33) - 1)}).write.mode("overwrite").partitionBy("_part").parquet(self.path)
        counts = self.spark.read.parquet(self.path).groupBy("_part").count().collect() if not rows.isEmpty() else []  # a row for each stretch
        _put(self.path, "_counts.json", sorted((r["_part"], r["count"]) for r in counts))

    def count(self) -> int:
        return sum(n for _, n in _get(self.path, "_counts.json"))

    def page(self, k: int, size: int = 1) -> DataFrame | None:
        """The k-th page, from 0, in order; None beyond the last one."""
        first, last, before, some = k * size, (k + 1) * size, 0, []
        for part, n in _get(self.path, "_counts.json"):
            low, high = max(first - before, 0), min(last - before, n)
            if low < high:
                some.append((part, low, high))
            before += n
        if not some:
            return None
        # each stretch's folder by name, so that no other is even listed
        reads = [self.spark.read.option("basePath", self.path).parquet(f"{self.path}/_part={p}").where((F.col("_at") >= low) & (F.col("_at") < high)) for p, low, high in some]
        out = reads[0]
        for more in reads[1:]:
            out = out.unionByName(more)
        return out.orderBy("_part", "_at").drop("_part", "_at")
