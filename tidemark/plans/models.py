"""Models of tickers, sectors and all together, trained at once; predictions that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.market import urgency_rank
from tidemark.operators.lineage import cut
from tidemark.operators.stored import StoredTable
from tidemark.plans.base import query, view
from tidemark.streaming.windows import checkpoint

FEATURES = ("last", "mean_5", "urgency", "hour")


def mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each mention that another follows: its ticker's recent mood, and whether the next is better."""
    order = Window.partitionBy("ticker").orderBy("mentioned_at", "article_id")
    rows = view(spark, sf_dir, "mentions_v").select(
        "ticker",
        "article_id",
        F.col("sentiment_score").alias("last"),
        F.avg("sentiment_score").over(order.rowsBetween(-4, 0)).alias("mean_5"),
        urgency_rank(F.col("urgency")).alias("urgency"),
        F.hour("mentioned_at").alias("hour"),
        F.lead("sentiment_score").over(order).alias("next"),
        F.row_number().over(order).alias("i"),
        F.count("*").over(Window.partitionBy("ticker")).alias("n"),
    )
    labelled = rows.where("next is not null").select("ticker", "article_id", *FEATURES, F.when(F.col("next") > F.col("last"), 1.0).otherwise(0.0).alias("label"), F.exp(-0.003 * (F.col("n") - F.col("i"))).alias("weight"), (F.col("i") * 4 > F.col("n") * 3).alias("held"))
    return labelled.join(view(spark, sf_dir, "sector_v"), "ticker")


@query("ticker_models")
def ticker_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by ticker on its newest quarter, by the most specific model that was trained on the rest: tickers with an even
    number have their own, of the others the first two sectors' have theirs (rows only)."""
    from tidemark.ml import boosting

    rows = cut(mention_rows(spark, sf_dir))
    number = F.substring("ticker", 2, 9).cast("int")
    known = boosting.in_scopes(rows.where("not held"))
    wanted = (F.col("scope") == "universal") | ((F.col("scope") == "ticker") & (number % 2 == 0)) | ((F.col("scope") == "sector") & F.col("sector").isin("Technology", "Energy"))
    models = boosting.fit_groups(known.where(wanted), FEATURES, rounds=8)
    scored = boosting.predict_groups(models, rows.where("held"), FEATURES)
    return boosting.metrics_by(scored, ["ticker", "scope"])


_SETTLED = "ticker string, day date, horizon_days int, direction string, confidence double, resolve_after date, is_correct int"


@query(
    "fast_predictions_kept",
    """with said as (select ticker, bar_date as day, case when c > 0 then 'UP' else 'DOWN' end as direction, round(least(0.52::double + 2 * abs(c), 0.85::double), 6) as confidence, later > close as up, later from
      (select *, (close - lag(close) over w) / lag(close) over w as c, lead(close, 2) over w as later from bars_v window w as (partition by ticker order by bar_date)) where c is not null)
    select ticker, day, 2 as horizon_days, direction, confidence, day + 2 as resolve_after, case when later is not null then ((direction = 'UP') = up)::int end as is_correct from said""",
    "bars_v",
)
def fast_predictions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions are kept by month, once for each ticker, day and horizon: a first run has the odd days, a second all
    with another confidence, of which the odd days' are not taken; then those whose horizon is over are resolved in place."""
    order = Window.partitionBy("ticker").orderBy("bar_date")
    before, later = F.lag("close").over(order), F.lead("close", 2).over(order)
    bars = view(spark, sf_dir, "bars_v").select("ticker", F.col("bar_date").alias("day"), "close", ((F.col("close") - before) / before).alias("c"), later.alias("later")).where("c is not null")
    confidence = F.round(F.least(0.52 + 2 * F.abs("c"), F.lit(0.85)), 6)
    said = bars.select("ticker", "day", F.lit(2).alias("horizon_days"), F.when(F.col("c") > 0, "UP").otherwise("DOWN").alias("direction"), confidence.alias("confidence"), F.date_add("day", 2).alias("resolve_after"), F.lit(None).cast("int").alias("is_correct"))
    kept = StoredTable(spark, f"{checkpoint(spark)}/predictions", _SETTLED, "day", ["ticker", "day", "horizon_days"])
    odd = F.dayofmonth("day") % 2 == 1
    kept.insert_ignore(said.where(odd), [F.col("direction")])
    kept.insert_ignore(said.withColumn("confidence", F.when(odd, 0.0).otherwise(F.col("confidence"))), [F.col("direction")])
    outcome = kept.read().join(bars.where("later is not null").select("ticker", "day", (F.col("later") > F.col("close")).alias("up")), ["ticker", "day"])
    kept.update(cut(outcome.select("ticker", "day", "horizon_days", ((F.col("direction") == "UP") == F.col("up")).cast("int").alias("is_correct"))))
    return kept.read()

