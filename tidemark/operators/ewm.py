"""Exponentially weighted means without recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a series that are summed with common weights.
SEGMENT = 2000


def ewm_mean(df: DataFrame, value: str, keys: list[str], order: list[str], span: int, name: str) -> DataFrame:
    """Adds the recursion e = a * x + (1 - a) * e, started at the first value.

    Written out, e_t = (1-a)^t * (x_0 + sum of a * x_i / (1-a)^i): a running sum, so no
    array of the series is built and no Python runs.  The weights would leave double
    range in a long series, so it is summed in segments; a segment's value at its
    last row, times (1-a)^n, carries on into the next one (older segments weigh
    nothing in double precision: spans up to SEGMENT / 40 are taken).
    """
    if span > SEGMENT // 40:
        raise ValueError(f"spans over {SEGMENT // 40} need longer segments")
    a = 2.0 / (span + 1)
    rows = Window.partitionBy(*keys).orderBy(*order)
    own = Window.partitionBy(*keys, "ewm_segment").orderBy("ewm_i")
    numbered = df.withColumn("ewm_i", F.row_number().over(rows) - 1).withColumn("ewm_segment", F.floor(F.col("ewm_i") / SEGMENT)).withColumn("ewm_k", F.col("ewm_i") % SEGMENT)
    share = F.when(F.col("ewm_i") == 0, F.col(value)).otherwise(a * F.col(value))
    inside = numbered.withColumn("ewm_in", F.pow(F.lit(1 - a), F.col("ewm_k")) * F.sum(share / F.pow(F.lit(1 - a), F.col("ewm_k"))).over(own))
    # the last row of the segment before stands k + 1 rows back
    before = F.last(F.when(F.col("ewm_k") == SEGMENT - 1, F.col("ewm_in")), ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    carried = F.coalesce(before * F.pow(F.lit(1 - a), F.col("ewm_k") + 1), F.lit(0.0))
    return inside.withColumn(name, F.col("ewm_in") + carried).drop("ewm_i", "ewm_segment", "ewm_k", "ewm_in")
