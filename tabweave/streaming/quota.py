"""A budget of calls for each key, kept as streaming state: over all tasks, and over restarts.

Requests of a key wait in its queue; at most `calls` of them are let through in any `seconds`, and a timer lets the next ones through when
the earliest call leaves that span. State is by key, so keys are spread over tasks and each is counted in one place.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Budget(StatefulProcessor):
    """Queue: requests by their number; ends: the first and the next number; calls: when those that count were let through."""

    def __init__(self, calls: int, milliseconds: int):
        self.most, self.span = calls, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "number long", "request string")
        self.ends = handle.getValueState("ends", "first long, next long")
        self.calls = handle.getListState("calls", "at long")

    def _release(self, key, now: int) -> Iterator[Row]:
        recent = [r[0] for r in self.calls.get() if r[0] > now - self.span] if self.calls.exists() else []
        first, last = self.ends.get() if self.ends.exists() else (0, 0)
        n = min(last - first, self.most - len(recent))
        for i in range(first, first + n):
            request = self.queue.getValue((i,))[0]
            self.queue.removeKey((i,))
            yield Row(key=key[0], request=request, granted_at=now)
        recent += [now] * n
        if n:
            self.ends.update((first + n, last))
            self.calls.put([(t,) for t in recent])
        if first + n < last:
            self.handle.registerTimer(min(recent) + self.span + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, last = self.ends.get() if self.ends.exists() else (0, 0)
        for row in rows:
            self.queue.updateValue((last,), (row["request"],))
            last += 1
        self.ends.update((first, last))
        yield from self._release(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._release(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def budgeted(requests: DataFrame, calls: int = 10, seconds: float = 60.0) -> DataFrame:
    """(key, request, granted_at) of a stream of (key, request): each request once, when its key's budget lets it through; granted_at in milliseconds.

    Requests of a key go in the order of their batches. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`), and a
    trigger that goes on without new rows, as waiting requests go by timers.
    """
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("request").cast("string").alias("request"))
    return rows.groupBy("key").transformWithState(_Budget(calls, int(seconds * 1000)), "key string, request string, granted_at long", "append", "processingTime")


def with_keys(requests: DataFrame, keys: list[str], column: str = "request") -> DataFrame:
    """The requests with one of the keys each, by a hash of the request."""
    return requests.withColumn("key", F.element_at(F.array(*(F.lit(k) for k in keys)), (F.pmod(F.xxhash64(column), F.lit(len(keys))) + 1).cast("int")))
