"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, is_empty

#: More rounds than any graph needs: their number grows with the logarithm of its size.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b) that is not the least of its component.

    The rounds end when a round changes nothing; each is cut off by a written table, and
    the last one is what is returned: discard() deletes it.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        then = cut(_small_star(_large_star(now)).distinct())
        same = is_empty(now.unionByName(then).groupBy("a", "b").count().where("count = 1"))
        discard(now)
        now = then
        if same:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.cut_path = now.cut_path
            return out
    raise RuntimeError("components did not settle")
