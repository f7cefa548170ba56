"""Keyed state: caches with a time to live for each kind, and retries that come back.

All times are event times: what a key remembers depends on its rows and not on how they fell into
batches, as long as no row is later than the watermark allows. Rows of a key are taken in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: For how many seconds each cache keeps a key.
TTL_SECONDS = {"url": 4 * 3600, "web": 3600, "trending": 24 * 3600, "themes": 4 * 3600, "advisory": 5 * 24 * 3600}
#: An item is tried this often at most.
MOST_ATTEMPTS = 3
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(spark: SparkSession) -> None:
    """Processors need the state store that keeps more than one state for a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Once(StatefulProcessor):
    """Lets a key through if it wasn't let through within its kind's time to live."""

    def __init__(self, ttl_ms: Mapping[str, int]):
        self.ttl_ms = dict(ttl_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, ttl = key[0], self.ttl_ms[key[0]]
        at = self.last.get()[0] if self.last.exists() else None
        before = at
        for t in sorted(r["at"] for r in rows):
            if at is None or t >= at + ttl:
                at = t
                yield Row(kind=kind, key=key[1], at=t)
        if at != before:
            self.last.update((at,))
            self.handle.registerTimer(at + ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The key is forgotten unless it was let through again since."""
        if self.last.exists() and self.last.get()[0] + self.ttl_ms[key[0]] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held besides the state."""


def once_within(rows: DataFrame, ttl_seconds: Mapping[str, int] = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """kind, key, at of the rows (kind, key, at: timestamp) that find their key not in the cache of
    their kind: it wasn't let through for that kind's seconds. Kinds without a time to live are left out."""
    _with_store(rows.sparkSession)
    known = rows.where(F.col("kind").isin(*ttl_seconds) & F.col("key").isNotNull()).withWatermark("at", late)
    keyed = known.select("kind", F.col("key").cast("string").alias("key"), F.unix_millis("at").alias("at"), F.col("at").alias("event_time"))
    schema = StructType([StructField("kind", StringType()), StructField("key", StringType()), StructField("at", LongType())])
    found = keyed.groupBy("kind", "key").transformWithState(_Once({k: s * 1000 for k, s in ttl_seconds.items()}), schema, "append", "eventTime")
    return found.withColumn("at", F.timestamp_millis("at"))


class _Retry(StatefulProcessor):
    """Counts a key's failures since its last success and brings it back a while after each but the last."""

    def __init__(self, after_ms: int, most: int):
        self.after_ms, self.most = after_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", StructType([StructField("n", LongType())]))
        self.due = handle.getMapState("due", StructType([StructField("at", LongType())]), StructType([StructField("attempt", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        for t, ok in sorted((r["at"], r["ok"]) for r in rows):
            if ok:
                n = 0
                if self.due.exists():
                    for at in [k[0] for k in self.due.keys() if k[0] > t]:
                        self.due.removeKey((at,))  # it has come through before its turn
                        self.handle.deleteTimer(at)
            elif n < self.most:
                n += 1
                if n < self.most:
                    self.due.updateValue((t + self.after_ms,), (n + 1,))
                    self.handle.registerTimer(t + self.after_ms)
        self.failures.update((n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.exists() and self.due.containsKey((at,)):
            attempt = self.due.getValue((at,))[0]
            self.due.removeKey((at,))
            yield Row(key=key[0], attempt=attempt, due=at)

    def close(self) -> None:
        """Nothing is held besides the state."""


def retries(outcomes: DataFrame, after_seconds: int, most: int = MOST_ATTEMPTS, late: str = "1 hour") -> DataFrame:
    """key, attempt, due: items to try again, once the watermark has passed the time.

    outcomes: key, at (timestamp), ok. A failure brings its key back after some seconds, as the next
    attempt, unless it succeeds before; with the last attempt it has its rest until a success. Of outcomes at one time failures come first."""
    _with_store(outcomes.sparkSession)
    keyed = outcomes.where("key is not null and ok is not null").withWatermark("at", late).select(F.col("key").cast("string").alias("key"), F.unix_millis("at").alias("at"), "ok", F.col("at").alias("event_time"))
    schema = StructType([StructField("key", StringType()), StructField("attempt", LongType()), StructField("due", LongType())])
    found = keyed.groupBy("key").transformWithState(_Retry(after_seconds * 1000, most), schema, "append", "eventTime")
    return found.withColumn("due", F.timestamp_millis("due"))
