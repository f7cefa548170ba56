"""First rows by an order, over all rows or in each group; ties are settled by the order given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most k rows of each group, with their place; Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place.cast("long")).where(F.col(rank) <= k)


def nth_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n-th row of each group that has one."""
    return top_per_group(df, keys, order, n).where(F.col("rank") == n).drop("rank")
