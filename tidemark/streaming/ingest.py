"""The ingest cycle as a stream: each micro-batch goes through the stages and is appended if new."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def has_rows(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cycle(stages: Sequence[Stage], path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: run the stages, keep rows whose key is new, append them.

    A batch that is tried again after a failure adds nothing twice, as its keys are there."""

    def land(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = F.row_number().over(Window.partitionBy(key).orderBy(order))
        fresh = batch.withColumn("ingest_place", place).where("ingest_place = 1").drop("ingest_place")
        if has_rows(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        for stage in stages:
            fresh = stage(fresh)
        fresh.write.mode("append").parquet(path)

    return land


def run(stream: DataFrame, stages: Sequence[Stage], path: str, checkpoint: str, key: str, order: str) -> None:
    """Everything that is there now, in micro-batches; a timer calls this again."""
    query = stream.writeStream.foreachBatch(cycle(stages, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
