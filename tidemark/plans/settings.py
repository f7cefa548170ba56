"""Settings and the watchlist, news of a sector, counters of an ingest cycle and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.topk import top_per_group
from tidemark.operators.upsert import insert_ignore
from tidemark.plans.base import query, table, view
from tidemark.streaming import windows
from tidemark.streaming.counters import COUNTERS, CounterTable, counted, observed


def read_settings(settings: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and value of each wanted (key, fallback); a key that isn't set has its fallback."""
    return wanted.join(settings.select("key", F.col("value").alias("set_value")), "key", "left").select("key", F.coalesce("set_value", "fallback").alias("value"))


def watch(watched: DataFrame, symbols: DataFrame) -> DataFrame:
    """The watchlist with symbols, in capitals; those that are on it already stay once."""
    return insert_ignore(watched, symbols.select(F.upper("symbol").alias("symbol")), ["symbol"], [F.col("symbol")])


def unwatch(watched: DataFrame, symbols: DataFrame) -> DataFrame:
    return watched.join(symbols.select(F.upper("symbol").alias("symbol")), "symbol", "left_anti")


@query("settings_read", "select r_name as key, case when r_regionkey % 2 = 0 then r_name || '!' else 'none' end as value from region")
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the even regions; the others take the fallback."""
    regions = table(spark, sf_dir, "region")
    there = regions.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("key"), F.concat("r_name", F.lit("!")).alias("value"))
    return read_settings(there, regions.select(F.col("r_name").alias("key"), F.lit("none").alias("fallback")))


@query("watchlist", "select distinct upper(name) as symbol from (select r_name as name from region union all select n_name from nation) where upper(name) not in (select upper(n_name) from nation where n_regionkey = 1)")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are watched, nations are added, in small letters, and one region's taken off again."""
    start = table(spark, sf_dir, "region").select(F.upper("r_name").alias("symbol"))
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("symbol"), "n_regionkey")
    return unwatch(watch(start, nations), nations.where("n_regionkey = 1"))


@query("cycle_counters", "select count(*) as fetched, count(event_type) as classified, count(importance_score) as ranked from articles_v", "articles_v")
def cycle_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a cycle as the row that is kept of it."""
    return view(spark, sf_dir, "articles_v").agg(*(F.expr(c).alias(k) for k, c in COUNTERS.items()))


@query("stream_counters", "select cast(count(*) as bigint) as fetched, cast(count(*) filter (where value > 100) as bigint) as loud, cast(count(*) filter (where value > 400) as bigint) as urgent from events")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of all micro-batches of a stream, from the table that the listener keeps of them."""
    where = windows.checkpoint(spark)
    counters = {"fetched": "count(*)", "loud": "count_if(value > 100)", "urgent": "count_if(value > 400)"}
    stream = observed(windows.read_events(spark, sf_dir), "events", counters)
    kept = CounterTable(spark, f"{where}/counters", "events")
    counted(stream.writeStream.format("noop").option("checkpointLocation", f"{where}/state").trigger(availableNow=True), kept)
    return kept.read().agg(*(F.coalesce(F.sum(F.col("counters")[c]), F.lit(0)).alias(c) for c in counters))


@query(
    "sector_news",
    """select sector, id, importance_score from (select s.sector, a.id, a.importance_score, row_number() over (partition by s.sector order by a.importance_score desc, a.id) as r
    from (select *, source_name || ',all' as sectors from articles_v) a join (select distinct source_name as sector from articles_v) s on list_contains(string_split(a.sectors, ','), s.sector)
    where a.importance_score >= 5 and a.published_at >= timestamp '2024-01-18' and (a.event_type is null or a.event_type <> 'noise')) where r <= 10""",
    "articles_v",
)
def sector_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sector the ten most important articles of the last week that name it among theirs.

    An article's sectors are a comma list; it is split, so that a name never matches inside
    another's, and each sector's articles meet by name, for all sectors at once."""
    articles = view(spark, sf_dir, "articles_v").withColumn("sectors", F.concat("source_name", F.lit(",all")))
    noise = F.col("event_type").isNotNull() & (F.col("event_type") == "noise")
    recent = articles.where((F.col("importance_score") >= 5) & (F.col("published_at") >= F.lit("2024-01-18").cast("timestamp_ntz")) & ~noise)
    named = recent.select("id", "importance_score", F.explode(F.array_distinct(F.split("sectors", ","))).alias("sector"))
    sectors = articles.select(F.col("source_name").alias("sector")).distinct()
    best = top_per_group(named.join(sectors, "sector", "left_semi"), ["sector"], [F.desc("importance_score"), F.col("id")], 10)
    return best.select("sector", "id", "importance_score")
