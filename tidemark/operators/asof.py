"""As-of and band joins as unions, windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: list[str], tie: str) -> DataFrame:
    """Each left row with the columns `take` of the newest right row of its key that is not
    later; equal times count, the greatest `tie` wins.  One shuffle by key: both sides
    are merged in time order and the last right row is carried along."""
    carried = F.struct(*take)
    marked_left = left.withColumn("asof_time", F.col(left_time)).withColumn("asof_side", F.lit(1)).withColumn("asof_tie", F.lit(None).cast(right.schema[tie].dataType))
    marked_right = right.select(F.col(on), F.col(right_time).alias("asof_time"), F.lit(0).alias("asof_side"), F.col(tie).alias("asof_tie"), carried.alias("asof_row"))
    both = marked_left.unionByName(marked_right, allowMissingColumns=True)
    order = Window.partitionBy(on).orderBy("asof_time", "asof_side", "asof_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("asof_seen", F.last("asof_row", ignorenulls=True).over(order)).where("asof_side = 1")
    return seen.select(*left.columns, *(F.col(f"asof_seen.{c}").alias(c) for c in take))


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, days: int, on: list[Column] | None = None) -> DataFrame:
    """Pairs whose times differ by at most `days`: the right side is sent to the three bins
    of that width around it, so the join is an equi-join on bins with a residual."""
    width = days * 86_400_000_000
    lm, rm = F.unix_micros(F.col(left_time).cast("timestamp")), F.unix_micros(F.col(right_time).cast("timestamp"))
    left_binned = left.withColumn("band_l", lm).withColumn("band_bin", F.floor(F.col("band_l") / width))
    right_binned = right.withColumn("band_r", rm).withColumn("band_bin", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.floor(F.col("band_r") / width) + k)))
    joined = left_binned.join(right_binned, "band_bin").where(F.abs(F.col("band_l") - F.col("band_r")) <= width)
    for condition in on or []:
        joined = joined.where(condition)
    return joined.drop("band_l", "band_r", "band_bin")
