"""Tables that are written and read back: prices, predictions, a cycle's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stored import StoredTable
from tidemark.plans.base import query, view
from tidemark.streaming import windows


@query(
    "prices_stored",
    """select ticker, bar_date, case when bar_date >= date '2024-01-10' then close + 1 else close end as close, volume from bars_v where not (volume < 20 and bar_date < date '2024-01-05')
    union all select ticker || '.X', bar_date, close, volume from bars_v where bar_date >= date '2024-01-10'""",
    "bars_v",
)
def prices_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are kept by day; later days come a second time, corrected and with more tickers, a third
    time as they are (each a replacement); thin old days are deleted."""
    bars = view(spark, sf_dir, "bars_v").select("ticker", "bar_date", "close", "volume")
    kept = StoredTable(spark, f"{windows.checkpoint(spark)}/prices", "ticker string, bar_date date, close double, volume bigint", "bar_date", ["ticker", "bar_date"])
    kept.replace(bars)
    late = bars.where("bar_date >= date '2024-01-10'")
    again = late.withColumn("close", F.col("close") + 1).unionByName(late.withColumn("ticker", F.concat("ticker", F.lit(".X"))))
    for _ in range(2):
        kept.replace(again)
    kept.delete((F.col("volume") < 20) & (F.col("bar_date") < F.lit("2024-01-05").cast("date")))
    return kept.read()


@query(
    "predictions_stored",
    """select id, ticker, date_trunc('month', created_at)::date as month, case when id % 3 = 0 then coalesce(is_correct, 1) else is_correct end as is_correct from predictions_v where id % 5 <> 4""",
    "predictions_v",
)
def predictions_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions are kept once, told again without effect, resolved in place, and some deleted by two conditions."""
    said = view(spark, sf_dir, "predictions_v").select("id", "ticker", F.trunc("created_at", "month").alias("month"), "is_correct")
    kept = StoredTable(spark, f"{windows.checkpoint(spark)}/predictions", "id bigint, ticker string, month date, is_correct int", "month", ["id", "month"])
    kept.insert_ignore(said, [F.col("ticker")])
    kept.insert_ignore(said.withColumn("ticker", F.lit("told again")), [F.col("ticker")])
    kept.update(said.where("id % 3 = 0").select("id", "month", F.coalesce("is_correct", F.lit(1)).alias("is_correct")))
    kept.delete(F.col("id") % 10 == 4, F.col("id") % 10 == 9)
    return kept.read()
