"""Vectors as whole numbers: what the operators on embeddings share.

A component x counts as floor(256 * x).  Vectors that are null, or hold a null or a
non-finite component, are left out; shorter vectors count as followed by zeros up to the
longest one.  So that sums of products fit 64-bit integers, components are held within
a bound that depends on the length alone (some 23 million at 64 components, x of 92,000).
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named, shuffles_end

SCALE = 256
#: Sums of products of two vectors stay below this.
LARGEST = 1 << 55


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor holding a null or non-finite component."""
    each = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, each), F.lit(False))


def whole_numbers(rows: DataFrame, vector_col: str, multiple: int = 1) -> tuple[DataFrame, int]:
    """The rows whose vector is usable, with the vector as array<int> column v, and the
    length of all v: the longest, rounded up to a multiple.  Ends in one pass over the lengths."""
    vector = named(vector_col)
    kept = rows.where(usable(vector))
    with shuffles_end(rows.sparkSession):
        longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    length = max(-(-longest // multiple) * multiple, multiple)
    most = min(isqrt(LARGEST // length), (1 << 31) - 1)
    scaled = F.transform(vector, lambda x: F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), F.floor(x.cast("double") * SCALE).cast("double"))).cast("int"))
    return kept.withColumn("v", F.concat(scaled, F.array_repeat(F.lit(0), F.lit(length) - F.size(vector)))), length


def matrix(column: pa.Array, length: int, kind=np.int64) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, length)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    n, length = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), pa.array(rows.reshape(-1), kind))
