"""Landed feeds read through the data source, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base import query, table
from tidemark.sources.landing import read_feeds, stream_feeds
from tidemark.streaming import windows

_ITEMS = "array<struct<id:bigint,headline:string,source:string,datetime:bigint>>"


def land_documents(spark: SparkSession, sf_dir: str, root: str) -> list[str]:
    """Documents as JSON payloads of a hundred, a folder for each source; the sources' names."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    item = F.struct(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("headline"), "source", (F.col("doc_id") * 60).alias("datetime"))
    payloads = docs.groupBy("source", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))
    payloads.select(F.col("source").alias("feed"), "payload").write.partitionBy("feed").option("maxRecordsPerFile", 1).text(root)
    return sorted(r.source for r in docs.select("source").distinct().collect())  # feeds are few: each is configured by name


def told(landed: DataFrame) -> DataFrame:
    """The items of the payloads."""
    items = landed.select(F.col("source").alias("feed"), F.explode(F.from_json("payload", _ITEMS)).alias("x"))
    return items.select("feed", F.col("x.id").alias("id"), F.col("x.headline").alias("headline"), F.timestamp_seconds("x.datetime").cast("timestamp_ntz").alias("published_at"))


_SQL = "select source as feed, doc_id as id, substr(text, 1, 80) as headline, make_timestamp(doc_id * 60000000) as published_at from documents where source is not null"


@query("feeds_read", _SQL)
def feeds_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds, with a first mirror that is not there."""
    root = f"{windows.checkpoint(spark)}/feeds"
    sources = land_documents(spark, sf_dir, root)
    return told(read_feeds(spark, [f"{root}-gone", root], sources, folder="feed={source}", accept=r"^\s*\["))


@query("feeds_stream", _SQL.replace("select source as feed, doc_id as id", "select source as feed, count(*) as n, min(doc_id) as first, max(doc_id) as last").split(", substr")[0] + " from documents where source is not null group by 1")
def feeds_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, drained twice: the second run finds nothing new."""
    where = windows.checkpoint(spark)
    sources = land_documents(spark, sf_dir, f"{where}/feeds")
    for _ in range(2):
        items = told(stream_feeds(spark, [f"{where}/gone", f"{where}/feeds"], sources, folder="feed={source}"))
        items.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    landed = spark.read.parquet(f"{where}/out")
    return landed.groupBy("feed").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
