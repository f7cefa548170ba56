"""A running aggregate as a subscriber sees it: a snapshot first, then what changes, a heartbeat when nothing comes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.streaming.states import _with_store

#: Fixed value: seconds without news after which a heartbeat is sent.
HEARTBEAT_SECONDS = 30
SCHEMA = StructType([StructField("topic", StringType()), StructField("kind", StringType()), StructField("n", LongType()), StructField("total", DoubleType())])


class _Push(StatefulProcessor):
    """Count and sum of a topic: the first time as a snapshot, then as increments of what came."""

    def __init__(self, heartbeat_ms: int):
        self.heartbeat_ms = heartbeat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", StructType([StructField("n", LongType()), StructField("total", DoubleType()), StructField("timer", LongType())]))

    def _wait(self, timerValues) -> int:
        at = timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came, more = 0, 0.0
        for r in rows:
            came, more = came + 1, more + (r["value"] or 0.0)
        new = not self.sums.exists()
        n, total, timer = (0, 0.0, 0) if new else self.sums.get()
        if not new:
            self.handle.deleteTimer(timer)
        self.sums.update((n + came, total + more, self._wait(timerValues)))
        yield Row(topic=key[0], kind="snapshot", n=n + came, total=total + more) if new else Row(topic=key[0], kind="increment", n=came, total=more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, total, _ = self.sums.get()
        self.sums.update((n, total, self._wait(timerValues)))
        yield Row(topic=key[0], kind="heartbeat", n=0, total=0.0)

    def close(self) -> None:
        """Nothing is held besides the state."""


def pushed(rows: DataFrame, heartbeat_seconds: float = HEARTBEAT_SECONDS) -> DataFrame:
    """topic, kind (snapshot, increment or heartbeat), n and total of rows (topic, value), in update mode."""
    _with_store(rows.sparkSession)
    keyed = rows.where("topic is not null").select(F.col("topic").cast("string").alias("topic"), F.col("value").cast("double").alias("value"))
    return keyed.groupBy("topic").transformWithState(_Push(int(heartbeat_seconds * 1000)), SCHEMA, "update", "processingTime")
