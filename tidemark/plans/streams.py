"""Streaming queries, run to the end of the table; their SQL is the batch equivalent.

Results are those that the watermark (an hour behind the newest event) has passed; the newest
windows and sessions are still open, as in any stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base import query, table
from tidemark.streaming import increments, staged, states, windows


@query(
    "stream_sliding_6h",
    "select event_type, b - interval 15 minute * k as window_start, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from (select *, time_bucket(interval 15 minute, ts) as b from events), (select unnest(range(24)) as k) group by 1, 2 having window_start + interval 6 hour <= (select max(ts) - interval 1 hour from events)",
)
def stream_sliding_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drain(windows.sliding(windows.read_events(spark, sf_dir)))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", F.col("total").cast("double").alias("total"))


@query("stream_daily", "select event_type, date_trunc('day', ts)::timestamp as window_start, count(*) as n, max(value) as top from events group by 1, 2 having window_start + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drain(windows.tumbling(windows.read_events(spark, sf_dir)))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "top")


@query("stream_ttl_dedup", "select count(distinct (user_id, event_type)) as keys from events")
def stream_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of a type; the table arrives in one batch, within one watermark."""
    out = windows.drain(windows.first_in_ttl(windows.read_events(spark, sf_dir), ["user_id", "event_type"]))
    return out.agg(F.count("*").alias("keys"))


@query(
    "stream_sessions",
    "select user_id, min(ts)::timestamp as first_ts, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, s having max(ts) + interval 30 minute <= (select max(ts) - interval 1 hour from events)",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drain(windows.sessions(windows.read_events(spark, sf_dir), "user_id"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("stream_topics", "select event_type, count(*) as n from events where event_type in ('click', 'error') group by 1")
def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics that somebody reads, each in its own folder."""
    where = windows.checkpoint(spark)
    windows.by_topic(windows.read_events(spark, sf_dir), f"{where}/out", f"{where}/state", ["click", "error"])
    return spark.read.parquet(f"{where}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "stream_caches",
    """with recursive keyed as (select case when event_type = 'click' then 'url' else 'web' end as kind, user_id::varchar as key, date_trunc('millisecond', ts) as t, case when event_type = 'click' then interval 4 hour else interval 1 hour end as ttl from events),
    admitted as (select kind, key, ttl, min(t) as t from keyed group by kind, key, ttl
      union all select * from (select l.kind, l.key, l.ttl, (select min(k.t) from keyed k where k.kind = l.kind and k.key = l.key and k.t >= l.t + l.ttl) as t from admitted l) where t is not null)
    select kind, key, t::timestamp as at from admitted""",
)
def stream_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' clicks through a cache of four hours, all else through one of an hour: what is let through."""
    events = windows.read_events(spark, sf_dir)
    rows = events.select(F.when(F.col("event_type") == "click", "url").otherwise("web").alias("kind"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return windows.drain(states.once_within(rows, {"url": 4 * 3600, "web": 3600})).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "stream_retries",
    """with told as (select user_id::varchar as key, date_trunc('millisecond', ts) as t, event_type <> 'error' as ok from events),
    runs as (select *, sum(ok::int) over (partition by key order by t, ok range between unbounded preceding and current row) as run from told),
    fails as (select key, t, row_number() over (partition by key, run order by t) as n from runs where not ok)
    select key, n + 1 as attempt, (t + interval 30 minute)::timestamp as due from fails f
    where n < 3 and not exists (select 1 from told g where g.key = f.key and g.ok and g.t >= f.t and g.t < f.t + interval 30 minute)
    and t + interval 30 minute <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)""",
)
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors bring their user back after half an hour, twice in a row at most, unless something else came first."""
    told = windows.read_events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return windows.drain(states.retries(told, 1800)).withColumn("due", F.col("due").cast("timestamp_ntz"))


@query(
    "staged_cycle",
    """select event_id, case when event_id % 97 <> 0 then case when value > 400 then 'high' when value > 100 then 'medium' else 'low' end end as urgency,
    case when event_id % 97 <> 0 then round(case when value <= 100 then 1.0 else value / 50 end, 6) end as importance from events""",
)
def staged_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through two stages whose limits are less than all rows, landed in two batches that overlap; each 97th
    gets no answer and is given up. As many cycles run as it takes."""
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "ts", "value")
    limit = max(events.count() * 2 // 3, 1)  # 50 and 20 in production, with rows to match
    urgency = F.when(F.col("value") > 400, "high").when(F.col("value") > 100, "medium").otherwise("low")
    classify = staged.Stage("classify", limit, lambda rows: rows.where("event_id % 97 <> 0").select("event_id", "day", urgency.alias("urgency")))
    importance = F.round(F.when(F.col("urgency") == "low", 1.0).otherwise(F.col("value") / 50), 6)
    rank = staged.Stage("rank", limit, lambda rows: rows.select("event_id", "day", importance.alias("importance")))
    schema = "event_id bigint, day date, ts timestamp_ntz, value double, urgency string, importance double"
    cycle = staged.StagedCycle(spark, f"{windows.checkpoint(spark)}/staged", schema, "event_id", "day", "ts", [classify, rank], attempts=2)
    cycle.land(events.where("event_id % 3 <> 0"))
    cycle.land(events.where("event_id % 3 <> 1"))
    cycle.drain()
    return cycle.rows.read().select("event_id", "urgency", "importance")


@query("stream_increments", "select event_type as topic, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber to all topics adds up to: a snapshot and the increments after it."""
    where = windows.checkpoint(spark)
    sent = increments.pushed(windows.read_events(spark, sf_dir).select(F.col("event_type").alias("topic"), "value"))

    def land(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{where}/out")

    batches = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(batches)
    spark.conf.set(batches, "false")  # else batches without data come for the heartbeats, without an end
    try:
        sent.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(batches, before)
    told = spark.read.parquet(f"{where}/out")
    return told.groupBy("topic").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
