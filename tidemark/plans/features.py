"""Point-in-time features for all tickers and days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.market import urgency_rank
from tidemark.operators.asof import asof_join
from tidemark.plans.base import query, r6, table, view
from tidemark.plans.indicators import series


def as_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that have bars, a row for each day of the calendar at most; what is known by the
    end of a day counts."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()


def sentiment_features(mentions: DataFrame, days: DataFrame) -> DataFrame:
    """Means and counts over the last 1, 3, 7 and 14 days of each day and ticker.

    Mentions are summed by ticker and day first; a day's sums then go to the 14 days
    that look back on it, so raw mentions are shuffled once and partly summed before.
    """
    daily = mentions.groupBy("ticker", F.to_date("mentioned_at").alias("on")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("sentiment_score") * 100000).cast("long")).alias("s"), F.count_if(F.col("sentiment_score") > 0.15).alias("b"), F.max(urgency_rank(F.col("urgency"))).alias("u")
    )
    sent = daily.withColumn("day", F.explode(F.sequence("on", F.date_add("on", 13), F.expr("interval 1 day")))).withColumn("age", F.datediff("day", "on"))
    sent = sent.join(F.broadcast(days), "day", "left_semi")

    def within(n: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("age") < n, F.col(column))), F.lit(0))

    sums = sent.groupBy("ticker", "day").agg(*(within(n, c).alias(f"{c}{n}") for n in (1, 3, 7, 14) for c in ("n", "s")), within(7, "b").alias("b7"), F.max(F.when(F.col("age") < 7, F.col("u"))).alias("u7"))

    def mean(n: int) -> Column:
        return F.coalesce(F.try_divide(F.col(f"s{n}") / 100000.0, F.col(f"n{n}")), F.lit(0.0))

    return sums.select(
        "ticker", "day",
        *(r6(mean(n)).alias(f"sentiment_{n}d") for n in (1, 3, 7, 14)),
        F.col("n7").alias("mentions_7d"),
        r6(mean(3) - mean(14)).alias("momentum"),
        r6(F.coalesce(F.try_divide(F.col("n1") * 7.0, F.col("n7")), F.lit(0.0))).alias("velocity"),
        r6(F.coalesce(F.try_divide(F.col("b7"), F.col("n7")), F.lit(0.0))).alias("bullish_ratio"),
        F.coalesce("u7", F.lit(0)).cast("long").alias("max_urgency_24h"),
    )


_SENTIMENT_SQL = """select ticker, day, round(coalesce(s1 / 100000.0::double / nullif(n1, 0), 0), 6) as sentiment_1d, round(coalesce(s3 / 100000.0::double / nullif(n3, 0), 0), 6) as sentiment_3d, round(coalesce(s7 / 100000.0::double / nullif(n7, 0), 0), 6) as sentiment_7d,
round(coalesce(s14 / 100000.0::double / nullif(n14, 0), 0), 6) as sentiment_14d, n7 as mentions_7d, round(coalesce(s3 / 100000.0::double / nullif(n3, 0), 0) - coalesce(s14 / 100000.0::double / nullif(n14, 0), 0), 6) as momentum,
round(coalesce(n1 * 7.0::double / nullif(n7, 0), 0), 6) as velocity, round(coalesce(b7::double / nullif(n7, 0), 0), 6) as bullish_ratio, coalesce(u7, 0)::bigint as max_urgency_24h from (
select ticker, day, count(*) filter (where age < 1) as n1, count(*) filter (where age < 3) as n3, count(*) filter (where age < 7) as n7, count(*) as n14,
coalesce(sum(x) filter (where age < 1), 0)::double as s1, coalesce(sum(x) filter (where age < 3), 0)::double as s3, coalesce(sum(x) filter (where age < 7), 0)::double as s7, sum(x)::double as s14,
count(*) filter (where age < 7 and sentiment_score > 0.15) as b7, max(case urgency when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end) filter (where age < 7) as u7 from (
select m.*, d.day, date_diff('day', cast(mentioned_at as date), d.day) as age, cast(round(sentiment_score * 100000) as bigint) as x from mentions_v m
join (select distinct cast(ts as date) as day from events) d on cast(mentioned_at as date) <= d.day and cast(mentioned_at as date) > d.day - 14) group by ticker, day)"""


@query("sentiment_features_asof", _SENTIMENT_SQL, "mentions_v")
def sentiment_features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment_features(view(spark, sf_dir, "mentions_v"), as_of_days(spark, sf_dir))


@query(
    "asof_last_order",
    "select e.event_id, o.o_orderkey, o.o_totalprice from (select event_id, user_id, timestamp '1998-01-01' + (ts - timestamp '2024-01-01') * 10 as t from events) e asof left join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2) o on o.o_custkey = e.user_id and o.o_orderdate <= e.t",
)
def asof_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's newest order by then."""
    shifted = F.lit("1998-01-01").cast("timestamp_ntz") + (F.col("ts") - F.lit("2024-01-01").cast("timestamp_ntz")) * 10
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey"), shifted.alias("t"))
    found = asof_join(events, table(spark, sf_dir, "orders"), "o_custkey", "t", "o_orderdate", ["o_orderkey", "o_totalprice"], "o_orderkey")
    return found.select("event_id", "o_orderkey", "o_totalprice")


@query(
    "market_regime_features",
    """select a.ticker, a.bar_date, round(v.close, 6) as vix, round(s.r, 6) as spx_return from bars_v a left join bars_v v on v.ticker = 'error' and v.bar_date = a.bar_date
    left join (select bar_date, (close - lag(close) over (order by bar_date)) / lag(close) over (order by bar_date) as r from bars_v where ticker = 'view') s on s.bar_date = a.bar_date where a.ticker not in ('error', 'view')""",
    "bars_v",
)
def market_regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index series beside every ticker's day: two of the series stand for the indices."""
    bars = view(spark, sf_dir, "bars_v")
    before = F.lag("close").over(series())
    index = bars.where(F.col("ticker").isin("error", "view")).withColumn("r", (F.col("close") - before) / before)
    regime = index.groupBy("bar_date").agg(F.max(F.when(F.col("ticker") == "error", F.col("close"))).alias("vix"), F.max(F.when(F.col("ticker") == "view", F.col("r"))).alias("spx_return"))
    others = bars.where(~F.col("ticker").isin("error", "view"))
    return others.join(regime, "bar_date", "left").select("ticker", "bar_date", r6("vix").alias("vix"), r6("spx_return").alias("spx_return"))
