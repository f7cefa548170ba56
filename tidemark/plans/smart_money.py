"""Insider transactions, stakes and investor flows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.market import signed_log
from tidemark.operators.topk import top_per_group
from tidemark.plans.base import ORDERS_AS_OF, at, query, r6, view

CENTS = "decimal(18,2)"
_WINDOW = "filed_at > timestamp '1998-04-01 23:59:59' and filed_at <= timestamp '1998-06-30 23:59:59'"


def last_days(insider: DataFrame, days: int) -> DataFrame:
    """Transactions known (filed) in the days up to the as-of time."""
    return insider.where((F.col("filed_at") > at(ORDERS_AS_OF - timedelta(days=days))) & (F.col("filed_at") <= at(ORDERS_AS_OF)))


def buy() -> Column:
    return (F.col("transaction_code") == "P") & (F.col("is_discretionary") == 1)


def sell() -> Column:
    """Any discretionary transaction that is no purchase."""
    return (F.col("transaction_code") != "P") & (F.col("is_discretionary") == 1)


@query(
    "insider_panel",
    f"""select ticker, cast(coalesce(sum(cast(value_usd as decimal(18,2))), 0) as double) as net_usd, count(*) filter (where transaction_code = 'P' and is_discretionary = 1) as buys,
    count(*) filter (where transaction_code <> 'P' and is_discretionary = 1) as sells, count(distinct case when transaction_code = 'P' then insider_name end) as buyers from insider_v where {_WINDOW} group by ticker""",
    "insider_v",
)
def insider_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_days(view(spark, sf_dir, "insider_v"), 90)
    net = F.coalesce(F.sum(F.col("value_usd").cast(CENTS)), F.lit(0).cast(CENTS)).cast("double")
    return rows.groupBy("ticker").agg(net.alias("net_usd"), F.count_if(buy()).alias("buys"), F.count_if(sell()).alias("sells"), F.count_distinct(F.when(F.col("transaction_code") == "P", F.col("insider_name"))).alias("buyers"))


@query(
    "insider_summary",
    f"""select ticker, count(*) as n, round(count(*) filter (where transaction_code = 'P') / nullif(count(*) filter (where is_discretionary = 1), 0)::double, 6) as buy_ratio,
    max(filed_at) as last_filed, cast(max(transaction_date) filter (where transaction_code = 'P') as date) as last_buy from insider_v where {_WINDOW} group by ticker""",
    "insider_v",
)
def insider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_days(view(spark, sf_dir, "insider_v"), 90)
    ratio = F.try_divide(F.count_if(F.col("transaction_code") == "P").cast("double"), F.count_if(F.col("is_discretionary") == 1))
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), r6(ratio).alias("buy_ratio"), F.max("filed_at").alias("last_filed"), F.max(F.when(F.col("transaction_code") == "P", F.col("transaction_date"))).alias("last_buy"))


@query("recent_insider_activity", f"select line_key, ticker, value_usd from insider_v where {_WINDOW} order by abs(coalesce(value_usd, 0)) desc, line_key, ticker, insider_name limit 50", "insider_v")
def recent_insider_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs(F.coalesce("value_usd", F.lit(0.0)))
    return last_days(view(spark, sf_dir, "insider_v"), 90).orderBy(F.desc(size), "line_key", "ticker", "insider_name").limit(50).select("line_key", "ticker", "value_usd")


@query("signed_log", "select line_key, insider_name, round(sign(coalesce(value_usd, 0)) * least(log10(abs(coalesce(value_usd, 0)) + 1) / 10, 1.0), 6) as scaled from insider_v", "insider_v")
def signed_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "insider_v").select("line_key", "insider_name", r6(signed_log(F.col("value_usd"))).alias("scaled"))


def month_starts(spark: SparkSession, first: str, last: str) -> DataFrame:
    """As-of times at the ends of the first days of months: a small table of stated times."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}', interval 1 month)) as as_of_day")
    return days.select("as_of_day", (F.col("as_of_day").cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")).alias("as_of"))


_ASOF_SQL = "(select cast(d as date) as as_of_day, d + interval '23:59:59' hour to second as as_of from unnest(generate_series(timestamp '1997-01-01', timestamp '1998-06-01', interval 1 month)) t(d))".replace(
    "interval '23:59:59' hour to second", "interval '86399 seconds'"
)


def _seen(spark: SparkSession, facts: DataFrame, days: int, months: int) -> DataFrame:
    """Facts (filed_at, ...) once for each as-of time that sees them: filed up to it and less than some days
    before, which so many further months cover."""
    month = F.trunc(F.to_date("filed_at"), "month")
    sent = facts.withColumn("month", F.explode(F.sequence(month, F.add_months(month, months), F.expr("interval 1 month"))))
    times = month_starts(spark, "1997-01-01", "1998-06-01").withColumn("month", F.trunc("as_of_day", "month"))
    return sent.join(F.broadcast(times), "month").where(f"filed_at <= as_of and filed_at > as_of - interval {days} days")


@query(
    "insider_features_asof",
    f"""select as_of_day, ticker, count(*) filter (where b) as buys_90, count(*) filter (where s) as sells_90, count(distinct case when b and filed_at > as_of - interval 30 day then insider_name end) as buyers_30,
    round(sign(coalesce(net, 0)) * least(log10(abs(coalesce(net, 0)) + 1) / 10, 1.0), 6) as net_30, date_diff('day', last_buy, as_of_day) as days_since_buy from (
    select *, sum(case when filed_at > as_of - interval 30 day then cast(value_usd as decimal(18,2)) end) over w as net, arg_max(transaction_date, (filed_at, line_key)) filter (where b) over w as last_buy from (
    select a.as_of_day, a.as_of, i.*, transaction_code = 'P' and is_discretionary = 1 as b, transaction_code <> 'P' and is_discretionary = 1 as s
    from {_ASOF_SQL} a join insider_v i on i.filed_at <= a.as_of and i.filed_at > a.as_of - interval 90 day) window w as (partition by as_of_day, ticker)) group by as_of_day, ticker, net, last_buy""",
    "insider_v",
)
def insider_features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of insiders at each as-of time: 90 days of filings, the time of filing included.

    Filings are summed by ticker and time of filing first; each sum is sent to the as-of times that
    see it (a filing month meets at most four), so a band join becomes an equi-join on months. Buyers
    are told apart by a second, narrower way: each one's purchases of a time once, for 30 days.
    """
    known = view(spark, sf_dir, "insider_v").where("filed_at > timestamp_ntz '1996-10-01' and filed_at < timestamp_ntz '1998-06-02'")  # 90 days before the first time, to the last
    newest = F.when(buy(), F.struct("filed_at", "line_key"))
    summed = known.groupBy("ticker", "filed_at").agg(
        F.count_if(buy()).alias("buys"),
        F.count_if(sell()).alias("sells"),
        F.sum(F.col("value_usd").cast(CENTS)).alias("value"),
        F.max(newest).alias("newest buy"),
        F.max_by(F.when(buy(), F.col("transaction_date")), newest).alias("bought on"),
    )
    in_30 = F.col("filed_at") > F.col("as_of") - F.expr("interval 30 days")
    out = _seen(spark, summed, 90, 4).groupBy("as_of_day", "ticker").agg(
        F.sum("buys").alias("buys_90"),
        F.sum("sells").alias("sells_90"),
        F.coalesce(F.sum(F.when(in_30, F.col("value"))), F.lit(0)).cast("double").alias("net"),
        F.max_by("bought on", "newest buy").alias("last_buy"),
    )
    buyers = _seen(spark, known.where(buy()).select("ticker", "filed_at", "insider_name").distinct(), 30, 2).groupBy("as_of_day", "ticker").agg(F.count_distinct("insider_name").alias("buyers"))
    out = out.join(buyers, ["as_of_day", "ticker"], "left").withColumn("buyers_30", F.coalesce("buyers", F.lit(0)))
    return out.select("as_of_day", "ticker", "buys_90", "sells_90", "buyers_30", r6(signed_log(F.col("net"))).alias("net_30"), F.datediff("as_of_day", "last_buy").cast("long").alias("days_since_buy"))


@query(
    "stake_features_asof",
    f"""select as_of_day, ticker, count(*) filter (where transaction_code = 'P' and filed_at > as_of - interval 90 day) as activist_90, count(*) as any_180 from {_ASOF_SQL} a
    join insider_v i on i.filed_at <= a.as_of and i.filed_at > a.as_of - interval 180 day where value_usd > 50000 group by as_of_day, ticker""",
    "insider_v",
)
def stake_features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large stakes known at each time; purchases stand for activist filings here."""
    stakes = view(spark, sf_dir, "insider_v").where("value_usd > 50000 and filed_at > timestamp_ntz '1996-07-01' and filed_at < timestamp_ntz '1998-06-02'")  # 180 days before the first time, to the last
    summed = stakes.groupBy("ticker", "filed_at").agg(F.count_if(F.col("transaction_code") == "P").alias("activist"), F.count("*").alias("n"))
    in_90 = F.col("filed_at") > F.col("as_of") - F.expr("interval 90 days")
    return _seen(spark, summed, 180, 7).groupBy("as_of_day", "ticker").agg(F.sum(F.when(in_90, F.col("activist")).otherwise(0)).alias("activist_90"), F.sum("n").alias("any_180"))




@query(
    "flow_features_5_20",
    """select ticker, trade_date, round(sum(inst_net) over (partition by ticker order by trade_date rows between 4 preceding and current row), 6) as inst_5,
    round(sum(inst_net) over (partition by ticker order by trade_date rows between 19 preceding and current row), 6) as inst_20,
    round(sum(foreign_net) over (partition by ticker order by trade_date rows between 4 preceding and current row), 6) as foreign_5,
    round(sum(foreign_net) over (partition by ticker order by trade_date rows between 19 preceding and current row) / nullif(sum(total_value) over (partition by ticker order by trade_date rows between 19 preceding and current row), 0), 6) as foreign_20_share from flows_v""",
    "flows_v",
)
def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the last 5 and 20 sessions (rows, not days)."""
    by_day = Window.partitionBy("ticker").orderBy("trade_date")
    five, twenty = by_day.rowsBetween(-4, 0), by_day.rowsBetween(-19, 0)
    share = F.try_divide(F.sum("foreign_net").over(twenty), F.sum("total_value").over(twenty))
    return view(spark, sf_dir, "flows_v").select(
        "ticker", "trade_date", r6(F.sum("inst_net").over(five)).alias("inst_5"), r6(F.sum("inst_net").over(twenty)).alias("inst_20"), r6(F.sum("foreign_net").over(five)).alias("foreign_5"), r6(share).alias("foreign_20_share")
    )


@query("flow_summary", "select ticker, round(sum(inst_net), 6) as inst_net, round(100 * sum(foreign_net) / nullif(sum(total_value), 0), 6) as foreign_pct, arg_max(inst_net, trade_date) as latest_inst, max(trade_date) as latest from flows_v group by ticker", "flows_v")
def flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "flows_v").groupBy("ticker").agg(
        r6(F.sum("inst_net")).alias("inst_net"), r6(F.try_divide(100 * F.sum("foreign_net"), F.sum("total_value"))).alias("foreign_pct"), F.max_by("inst_net", "trade_date").alias("latest_inst"), F.max("trade_date").alias("latest")
    )


@query("resume_watermark", "select ticker, max(filed_at) - interval 5 day as resume_from from insider_v group by ticker", "insider_v")
def resume_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next sync begins: five days before the newest filing, as filings come late."""
    return view(spark, sf_dir, "insider_v").groupBy("ticker").agg((F.max("filed_at") - F.expr("interval 5 days")).alias("resume_from"))


@query(
    "insider_last_five",
    "select ticker, r as rank, line_key, value_usd from (select *, row_number() over (partition by ticker order by filed_at desc, line_key, insider_name) as r from insider_v) where r <= 5",
    "insider_v",
)
def insider_last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(view(spark, sf_dir, "insider_v"), ["ticker"], [F.desc("filed_at"), F.col("line_key"), F.col("insider_name")], 5).select("ticker", "rank", "line_key", "value_usd")
