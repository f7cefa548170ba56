"""Counters of ingest cycles: counted on the rows' way, kept as a table by a listener."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What an ingest cycle counts of its rows.
COUNTERS = {"fetched": "count(*)", "classified": "count(event_type)", "ranked": "count(importance_score)"}
SCHEMA = "run_id string, batch_id bigint, recorded_at timestamp, duration_ms bigint, counters map<string,bigint>"


def observed(rows: DataFrame, name: str = "cycle", counters: dict[str, str] = COUNTERS) -> DataFrame:
    """rows, counted on their way without a pass of their own.  The counters are named by a
    string: an Observation object would stay in the session and keep models from being shipped."""
    return rows.observe(name, *(F.expr(c).alias(k) for k, c in counters.items()))


class CounterTable(StreamingQueryListener):
    """Appends a row for each micro-batch that was counted under a name: its run, number, time,
    duration and counters.  Batches without rows are counted too.  A batch that is told twice has two equal rows: read() gives one."""

    def __init__(self, spark: SparkSession, path: str, name: str = "cycle"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        """Nothing is counted yet."""

    def onQueryIdle(self, event) -> None:
        """A trigger without data is no cycle."""

    def onQueryTerminated(self, event) -> None:
        """All batches were told of before."""

    def onQueryProgress(self, event) -> None:
        told = json.loads(event.progress.json)
        found = told.get("observedMetrics", {}).get(self.name)
        if found is None:
            return
        row = [(told["runId"], told["batchId"], told["timestamp"], told.get("batchDuration"), {k: int(v) for k, v in found.items()})]
        text = SCHEMA.replace("recorded_at timestamp", "recorded_at string")
        made = self.spark.createDataFrame(row, text).withColumn("recorded_at", F.to_timestamp("recorded_at"))
        made.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).dropDuplicates(["run_id", "batch_id"])


def counted(stream_writer, listener: CounterTable):
    """Starts a stream's writer, runs it to its end with the listener, and waits until all its batches are told."""
    spark = listener.spark
    spark.streams.addListener(listener)
    try:
        query = stream_writer.start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return query
