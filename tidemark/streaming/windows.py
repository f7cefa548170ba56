"""Streaming counterparts of the batch views, over any streaming source of events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream; its times get a zone, which watermarks need."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    # a stream reads folders: of a table in one file, its folder with that name only
    stream = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding(events: DataFrame, width: str = "6 hours", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding counts and sums: quarter-hour sums first would spare the 24-fold rows, but the
    stream engine sums partly before the shuffle, which has the same effect."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def first_in_ttl(events: DataFrame, keys: list[str], ttl: str = "4 hours") -> DataFrame:
    """The first event of each key; the key is forgotten when the watermark passes."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def by_topic(events: DataFrame, path: str, checkpoint_at: str, topics: list[str] | None = None) -> None:
    """Land a stream as one folder for each topic (event_type), of all topics or those named;
    a subscriber reads its topic's folder at its own pace, so a slow one holds nobody up."""
    wanted = events if topics is None else events.where(F.col("event_type").isin(*topics))
    query = wanted.writeStream.outputMode("append").format("parquet").partitionBy("event_type").option("path", path).option("checkpointLocation", checkpoint_at).trigger(availableNow=True).start()
    query.awaitTermination()


def checkpoint(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there and return what it has settled: a window or session
    comes out once the watermark has passed its end, and its state goes.  The tables land
    below the shared checkpoint folder, so any executor can write and read them."""
    spark = stream.sparkSession
    where = checkpoint(spark)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out")
    writer.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")
