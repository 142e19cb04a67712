"""Operator 3: speaker roles of transcripts by a hidden Markov model, and canonical turns.

A step (a turn, or a line of a raw transcript) is seen through discrete features: its speaker marker, length, lines,
question mark and opening. Role, transition and feature counts of labelled conversations are Spark aggregates; decoding
is Viterbi. Conversations are cut into chunks of CHUNK steps so that none is ever held whole: each chunk gives the best
score from each role before it to each role at its end, stretches of JOINED chunks and then a conversation combine those
few numbers, and each chunk is then decoded between the roles that were chosen at its ends. Chunks are cut from rows that
are sorted over all machines, so neither a conversation nor a step's number holds more rows together than a chunk.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, staged

CHUNK = 256
#: Chunks whose scores are combined at once.
JOINED = 1024
#: Speaker markers at the beginning of a step, by the role they stand for.
MARKERS = {"user": "user|human|question|q|customer|me", "assistant": "assistant|ai|bot|answer|a|agent|model", "system": "system|instructions?|context"}
_MARK = r"(?i)^\s*(?:\[|<\|?|\*\*|#+\s*)?({})(?:\|?>|\]|\*\*)?\s*[:>\-]\s*"
FEATURES = ("marker", "size", "lines", "asks", "opens", "place")


def _marker(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(_MARK.format(names)), role) for role, names in MARKERS.items()), F.lit("none"))


def features(steps: DataFrame, text: str = "text", step: str = "turn") -> DataFrame:
    """The steps with one string column f_<name> for each feature; a null text is an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return steps.withColumns(
        {
            "f_marker": _marker(t),
            "f_size": F.least(F.floor(F.log2(F.length(t) + 1) * 2), F.lit(40)).cast("string"),
            "f_lines": F.least(F.size(F.split(t, "\n", -1)), F.lit(8)).cast("string"),
            "f_asks": F.rtrim(t).endswith("?").cast("string"),
            "f_opens": F.when(t.rlike(r"^\s*$"), "blank").when(t.rlike(r"^\s*[-*\d]"), "list").when(t.rlike(r"^\s*\p{Lu}"), "capital").otherwise("other"),
            "f_place": F.when(F.col(step) == 0, "first").otherwise("later"),
        }
    )


def train(steps: DataFrame, id_col: str = "conv_id", step: str = "turn", role: str = "role", text: str = "text") -> dict:
    """Smoothed logarithms of start, transition and feature shares from steps with roles; the roles are those that occur.

    A transition is a step and the one numbered one more, counted once for each two roles there. Rows without role take no part; an empty table knows the roles of MARKERS alone.
    """
    known = features(steps.where(F.col(role).isNotNull()), text, step)
    columns = [F.struct(F.lit(f).alias("name"), F.col(f"f_{f}").alias("value")) for f in FEATURES]
    seen = known.select(F.col(role).alias("role"), F.explode(F.array(*columns)).alias("x")).groupBy("role", "x.name", "x.value").count().collect()
    roles = sorted({r["role"] for r in seen} | set(MARKERS))
    at = {r: i for i, r in enumerate(roles)}
    pair = known.select(F.col(id_col).alias("c"), F.col(step).alias("s"), F.col(role).alias("a")).distinct()  # so that repeated rows aren't paired with each other
    moves = pair.join(pair.select("c", (F.col("s") - 1).alias("s"), F.col("a").alias("b")), ["c", "s"]).groupBy("a", "b").count().collect()
    starts = known.where(F.col(step) == 0).groupBy(F.col(role).alias("a")).count().collect()
    trans, start = np.full((len(roles), len(roles)), 0.1), np.full(len(roles), 0.1)
    for r in moves:
        trans[at[r["a"]], at[r["b"]]] += r["count"]
    for r in starts:
        start[at[r["a"]]] += r["count"]
    values: dict[str, dict[str, np.ndarray]] = {f: {} for f in FEATURES}
    for r in seen:
        values[r["name"]].setdefault(r["value"], np.full(len(roles), 0.5))[at[r["role"]]] += r["count"]
    for f, of in values.items():
        total = sum(of.values(), np.zeros(len(roles))) + 0.5
        values[f] = {v: np.log(c / total) for v, c in of.items()} | {"": np.log(0.5 / total)}
    for role_name in MARKERS:  # a marker speaks for its role even where no labelled step has one
        if role_name not in values["marker"]:
            values["marker"][role_name] = np.where(np.arange(len(roles)) == at[role_name], -0.1, -6.0)
    return {"roles": roles, "start": np.log(start / start.sum()), "trans": np.log(trans / trans.sum(axis=1, keepdims=True)), "values": values}


def _emissions(model: dict, steps: list[dict]) -> np.ndarray:
    values = model["values"]
    return np.array([sum(values[f].get(s[f"f_{f}"], values[f][""]) for f in FEATURES) for s in steps])


def _best(model: dict, scores: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score at the end of a chunk from the given scores before it (one row for each way in), and where each came from."""
    back = np.empty((len(scores), *before.shape), np.int32)
    for k, e in enumerate(scores):
        ways = before[:, :, None] + model["trans"]
        back[k] = ways.argmax(axis=1)
        before = ways.max(axis=1) + e
    return before, back


def _enter(model: dict, chunk: int) -> np.ndarray:
    """Scores of the role before a chunk, for each way in. The first chunk has one way in, so weighted that its first move gives the start shares."""
    k = len(model["roles"])
    return np.where(np.eye(k, dtype=bool), 0.0, -1e18)


def _matrices(model: dict):
    def run(batches):
        for batch in batches:
            out = []
            for chunk, steps in zip(batch.column("chunk").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                scores = _emissions(model, steps)
                if chunk == 0:  # no role before: every way in gives the start shares
                    first = np.broadcast_to(model["start"] + scores[0], (len(model["roles"]),) * 2)
                    end = _best(model, scores[1:], first)[0]
                else:
                    end = _best(model, scores, _enter(model, chunk))[0]
                out.append(end.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(out, pa.list_(pa.float64()))], ["conv_id", "chunk", "matrix"])

    return run


def _products(model: dict):
    """One matrix for the chunks of a stretch: the best score from each role before it to each at its end."""

    def run(batches):
        k = len(model["roles"])
        for batch in batches:
            out = []
            for chunks in batch.column("chunks").to_pylist():
                total, *rest = (np.array(c["matrix"]).reshape(k, k) for c in chunks)
                for m in rest:
                    total = (total[:, :, None] + m).max(axis=1)
                out.append(total.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("stretch"), pa.array(out, pa.list_(pa.float64()))], ["conv_id", "chunk", "matrix"])

    return run


def _ends(model: dict, between: bool):
    """The role at the end of every chunk, and before it; between: for the given roles before and at the end of all of them."""

    def run(batches):
        k = len(model["roles"])
        for batch in batches:
            rows = ([], [], [], [])
            sides = zip(*(batch.column(c).to_pylist() for c in ("before", "end")), strict=True) if between else [(None, None)] * batch.num_rows
            for i, (chunks, (before, role)) in enumerate(zip(batch.column("chunks").to_pylist(), sides, strict=True)):
                score, back = np.where(np.arange(k) == before, 0.0, -1e18) if between else np.zeros(k), []
                for c in chunks:
                    ways = score[:, None] + np.array(c["matrix"]).reshape(k, k)
                    back.append(ways.argmax(axis=0))
                    score = ways.max(axis=0)
                role = role if between else int(score.argmax())
                for c, b in zip(reversed(chunks), reversed(back), strict=True):
                    for column, value in zip(rows, (i, c["chunk"], int(b[role]), role), strict=True):
                        column.append(value)
                    role = int(b[role])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:])], ["conv_id", "chunk", "before", "end"])

    return run


def _decode(model: dict):
    def run(batches):
        for batch in batches:
            out = []
            for chunk, steps, before, end in zip(*(batch.column(c).to_pylist() for c in ("chunk", "steps", "before", "end")), strict=True):
                scores = _emissions(model, steps)
                if chunk == 0:
                    _, back = _best(model, scores[1:], (model["start"] + scores[0])[None])
                else:
                    _, back = _best(model, scores, _enter(model, chunk)[before][None])
                roles = [end]
                for b in reversed(back):
                    roles.append(int(b[0, roles[-1]]))
                out.append([model["roles"][r] for r in roles[::-1][len(roles) - len(steps) :]])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("steps"), pa.array(out, pa.list_(pa.string()))], ["conv_id", "steps", "roles"])

    return run


def _chunks(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, steps): at most CHUNK steps each, in order of number and text; a conversation's first chunk is 0, later ones go up."""
    order = ["conv_id", "turn", "text"]
    names = ["turn", "text", *(f"f_{f}" for f in FEATURES)]
    # ids go up along the sorted rows of all partitions
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK) + 1)
    chunks = staged(features(at).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("steps")), "cut")
    lowest = chunks.groupBy(F.col("conv_id").alias("of")).agg(F.min("chunk").alias("least"))
    first = chunks.join(lowest, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("least")), "left")
    return first.select("conv_id", F.when(F.col("least").isNotNull(), 0).otherwise(F.col("chunk")).alias("chunk"), "steps")


def recover(steps: DataFrame, model: dict, id_col: str = "conv_id", step: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, content, rendered): every step with its recovered role, its text without the marker, and in canonical form.

    One row for each given. Steps are taken by number, then text; rows that repeat conversation, number and text are one step,
    whose role each of them gets; null numbers count as 0, null texts as empty, null conversations as one of their own. An empty
    table gives no row; other columns are not looked at.
    """
    kind = dict(steps.dtypes)[id_col]
    rows = steps.select(F.col(id_col).alias("conv_id"), F.coalesce(F.col(step), F.lit(0)).cast("long").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["turn", "text", *(f"f_{f}" for f in FEATURES)]
    chunks = staged(_chunks(rows.distinct()), "chunks")
    matrices = staged(chunks.mapInArrow(_matrices(model), f"conv_id {kind}, chunk long, matrix array<double>"), "matrices")
    stretch = F.floor(F.col("chunk") / JOINED).alias("stretch")
    stretches = matrices.groupBy("conv_id", stretch).agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("chunks"))
    products = stretches.mapInArrow(_products(model), f"conv_id {kind}, chunk long, matrix array<double>")
    outer = products.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("chunks")).mapInArrow(_ends(model, False), f"conv_id {kind}, chunk long, before long, end long")
    outer = outer.select(F.col("conv_id").alias("of"), F.col("chunk").alias("at"), "before", "end")
    inner = stretches.join(outer, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at"))).select("conv_id", "chunks", "before", "end")
    ends = inner.mapInArrow(_ends(model, True), f"conv_id {kind}, chunk long, before long, end long")
    ends = ends.select(F.col("conv_id").alias("of"), F.col("chunk").alias("at"), "before", "end")
    both = chunks.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))).select("conv_id", "chunk", "steps", "before", "end")
    inner = ", ".join(f"{n}: {'bigint' if n == 'turn' else 'string'}" for n in names)
    decoded = both.mapInArrow(_decode(model), f"conv_id {kind}, steps array<struct<{inner}>>, roles array<string>")
    out = decoded.select("conv_id", F.explode(F.arrays_zip("steps", "roles")).alias("x")).select("conv_id", "x.steps.turn", F.col("x.roles").alias("role"), F.col("x.steps.text").alias("text"), F.col("x.steps.f_marker").alias("marker"))
    every = rows.select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.col("text").alias("said"))  # a step for each row: large ones are split by skew handling
    out = out.join(every, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("at")) & (F.col("text") == F.col("said")))
    content = F.when(F.col("marker") == "none", F.trim("text")).otherwise(F.trim(F.regexp_replace("text", _MARK.format("|".join(MARKERS.values())), "")))
    return out.select("conv_id", "turn", "role", content.alias("content")).withColumn("rendered", _rendered())


def _rendered() -> Column:
    return F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>\n"))


def merged_turns(recovered: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, rendered): consecutive steps of one role as one turn, its lines joined; turn is its first step.

    For lines of transcripts. A conversation's steps pass through one window, which sorts on disk and holds none but the turn at hand.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "content")
    begins = recovered.withColumn("new", F.when(F.col("role").eqNullSafe(F.lag("role").over(order)), 0).otherwise(1))
    numbered = begins.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_sort(F.collect_list(F.struct("turn", "content")))
    out = numbered.groupBy("conv_id", "n", "role").agg(F.min("turn").alias("turn"), F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("content"))
    return out.select("conv_id", "turn", "role", "content").withColumn("rendered", _rendered())


def transcript_steps(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(conv_id, turn, text): the lines of raw transcripts that aren't blank, as steps."""
    rows = docs.select(F.col(id_col).alias("conv_id"), F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("turn", "text"))
    return rows.where(F.trim("text") != "")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """Roles of all turns of all conversations, recovered by a model of the conversations whose fold isn't 0, with the rendered turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    model = train(turns.where(F.coalesce(fold("conv_id") != 0, F.lit(True))))
    return recover(turns.drop("role"), model).select("conv_id", "turn", "role", "rendered", F.coalesce(fold("conv_id") == 0, F.lit(False)).alias("held_out"))
