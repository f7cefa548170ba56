"""The staged cycle: new rows go through stages of limited size; what is left over waits in a backlog.

Three stored tables below one root: the rows, in partitions of a column; the backlog, a row for each
stage that a row still waits for; and the watermark up to which each source was read. A cycle
reads the backlog and those partitions that its rows are in, never all keys. Each step can be done again: a row is in the backlog
before it is in the table, and leaves a stage's backlog after its result is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.operators.stored import StoredTable
from tidemark.operators.topk import top_per_group

#: Rows that a stage takes in a cycle, attempts for a row, days that a source is read again.
LIMITS = {"embed": 50, "classify": 20, "rank": 20}
MOST_ATTEMPTS, OVERLAP_DAYS = 3, 5


class Stage(NamedTuple):
    """work gets rows of the table and gives the keys and some columns of those that it has an answer for."""

    name: str
    limit: int
    work: Callable[[DataFrame], DataFrame]


class StagedCycle:
    """Rows with the columns of schema below root; key tells them apart, by is their partition, at their time."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, by: str, at: str, stages: Sequence[Stage], attempts: int = MOST_ATTEMPTS):
        self.spark, self.key, self.by, self.at, self.stages, self.attempts = spark, key, by, at, list(stages), attempts
        self.rows = StoredTable(spark, f"{root}/rows", schema, by, [key, by])
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        self.backlog = StoredTable(spark, f"{root}/backlog", f"stage string, {key} {kinds[key]}, {by} {kinds[by]}, {at} {kinds[at]}, attempts int", "stage", ["stage", key, by])
        self.seen = StoredTable(spark, f"{root}/seen", "source string, read_to timestamp", "source", ["source"])

    def land(self, new: DataFrame) -> None:
        """Rows whose key isn't there yet, each once, wait for the first stage."""
        once = cut(top_per_group(new, [self.key, self.by], [F.col(self.at)], 1))
        there = self.rows.read().join(once.select(self.by).distinct(), self.by, "left_semi").select(self.key, self.by)
        fresh = cut(once.join(there, [self.key, self.by], "left_anti"))
        for c in self.rows.schema.names:
            if c not in fresh.columns:
                fresh = fresh.withColumn(c, F.lit(None).cast(self.rows.schema[c].dataType))
        self.backlog.insert_ignore(fresh.select(F.lit(self.stages[0].name).alias("stage"), self.key, self.by, self.at, F.lit(0).alias("attempts")), [F.col(self.at)])
        self.rows.insert_ignore(fresh, [F.col(self.at)])

    def resume(self, source: str, read: Callable[[datetime | None], DataFrame], days: int = OVERLAP_DAYS) -> None:
        """Land what a source has since its watermark less some days, so that late rows come too, and raise the watermark."""
        known = self.seen.read().where(F.col("source") == source).agg(F.max("read_to")).first()[0]
        new = cut(read(None if known is None else known - timedelta(days=days)))
        self.land(new)
        newest = new.agg(F.max(F.col(self.at).cast("timestamp")).alias("t")).first().t
        if newest is not None and (known is None or newest > known):
            self.seen.replace(self.spark.createDataFrame([(source, newest)], self.seen.schema))

    def step(self) -> int:
        """One cycle: each stage takes its limit, oldest first; how many rows any of them took."""
        return sum(self._stage(i) for i in range(len(self.stages)))

    def _stage(self, i: int) -> int:
        stage = self.stages[i]
        waiting = self.backlog.read().where(F.col("stage") == stage.name)
        taken = cut(waiting.orderBy("attempts", self.at, self.key).limit(stage.limit))
        n = taken.count()
        if not n:
            return 0
        theirs = self.rows.read().join(taken.select(self.key, self.by), [self.key, self.by], "left_semi")
        done = cut(stage.work(theirs))
        self.rows.update(done)
        ids = done.select(self.key, self.by).distinct()
        if i + 1 < len(self.stages):
            self.backlog.insert_ignore(taken.join(ids, [self.key, self.by], "left_semi").withColumns({"stage": F.lit(self.stages[i + 1].name), "attempts": F.lit(0)}), [F.col(self.at)])
        # rows without an answer come back in a later cycle, behind the others, but for those that had their last attempt
        tried = cut(waiting.join(taken.select(self.key, self.by, F.lit(True).alias("taken")), [self.key, self.by], "left").join(ids.withColumn("answered", F.lit(True)), [self.key, self.by], "left"))
        left = tried.where("answered is null").withColumn("attempts", F.col("attempts") + F.coalesce(F.col("taken").cast("int"), F.lit(0)))
        self.backlog.overwrite(stage.name, left.where(F.col("attempts") < self.attempts))
        return n

    def drain(self) -> int:
        """Cycles until nothing waits; how many there were."""
        cycles = 0
        while self.step():
            cycles += 1
        return cycles
