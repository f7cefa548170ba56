"""Boosted stumps for many groups at once: every round is one grouped aggregation over all of them.

A group (a ticker, a sector, all together) has a model of its own. Features become bins by
the group's quantiles; a round sums gradients by (group, feature, bin), finds each group's best
split by running sums over the bins, and adds it to the group's stumps. Rows stay where they are: only
the table of models changes from round to round, so a group may be of any size, and the
sums of a large one are made where its rows are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

ROUNDS, BINS, RATE, REGULAR, LEAST_ROWS = 20, 16, 0.1, 1.0, 30
#: From the most specific on.
SCOPES = ("ticker", "sector", "universal")


def in_scopes(rows: DataFrame, ticker: str = "ticker", sector: str = "sector") -> DataFrame:
    """Each row once for each scope that it is in: scope and name of the model that learns from it.
    A row without a ticker or sector is in no model of that scope."""
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), name.alias("name")) for s, name in zip(SCOPES, (F.col(ticker), F.col(sector), F.lit("")), strict=True)))
    return rows.withColumn("of", F.explode(scopes)).where("of.name is not null").select("of.scope", "of.name", *rows.columns)


def _margin(features: Column, models: str = "") -> Column:
    """The sum of a model's stumps; a missing feature goes left."""
    step = lambda total, s: total + F.when(F.coalesce(F.get(features, s["feature"]) <= s["edge"], F.lit(True)), s["left"]).otherwise(s["right"])
    return F.aggregate(F.col(f"{models}stumps"), F.col(f"{models}base"), step)


def fit_groups(rows: DataFrame, features: Sequence[str], rounds: int = ROUNDS, bins: int = BINS, rate: float = RATE, least: int = LEAST_ROWS) -> DataFrame:
    """scope, name, n, base, stumps (feature, edge, left, right) of each group with enough rows of both labels.

    rows: scope, name, label (0 or 1), weight and the features. Ties between splits go to the
    first feature and the lowest bin. A group stops where no split gains anything."""
    keys = ["scope", "name"]
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    base = rows.where("label is not null and weight > 0").select(*keys, "label", "weight", values.alias("x"))
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    edges = F.array(*(F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(F.col("x")[i], shares, F.lit(10_000)))), F.array().cast("array<double>")) for i in range(len(features))))
    positive, total = F.sum(F.col("weight") * F.col("label")), F.sum("weight")
    able = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.log(F.try_divide(positive, total - positive)).alias("base"), edges.alias("edges"))
    groups = cut(able.where((F.col("n") >= least) & (F.col("lo") == 0) & (F.col("hi") == 1)).drop("lo", "hi"))
    # bin: how many edges lie below; x <= edge k just where bin <= k
    placed = F.transform("x", lambda v, i: F.when(v.isNull(), 0).otherwise(F.size(F.filter(F.get("edges", i), lambda e: e < v))))
    binned = cut(base.join(groups.select(*keys, "edges"), keys).select(*keys, "label", "weight", placed.alias("bin_of")))
    models = cut(groups.select(*keys, "n", "base", "edges", F.array().cast("array<struct<feature:int,bin:int,left:double,right:double>>").alias("stumps")))
    step = lambda t, s: t + F.when(F.get("bin_of", s["feature"]) <= s["bin"], s["left"]).otherwise(s["right"])
    for _ in range(rounds):
        scored = binned.join(models.select(*keys, "base", "stumps"), keys)
        p = 1 / (1 + F.exp(-F.aggregate("stumps", F.col("base"), step)))
        slopes = scored.select(*keys, F.posexplode("bin_of").alias("feature", "bin"), (F.col("weight") * (p - F.col("label"))).alias("g"), (F.col("weight") * p * (1 - p)).alias("h"))
        sums = slopes.groupBy(*keys, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        up_to = Window.partitionBy(*keys, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys, "feature")
        split = sums.select(*keys, "feature", "bin", F.sum("g").over(up_to).alias("gl"), F.sum("h").over(up_to).alias("hl"), F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"), (F.max("bin").over(whole) > F.col("bin")).alias("open"))
        side = lambda g, h: g * g / (h + REGULAR)
        gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
        gain = F.round(side(F.col("gl"), F.col("hl")) + side(gr, hr) - side(F.col("g"), F.col("h")), 9)
        leaf = lambda g, h: -rate * g / (h + REGULAR)
        stump = F.struct("feature", "bin", leaf(F.col("gl"), F.col("hl")).alias("left"), leaf(gr, hr).alias("right"))
        best = split.where("open").withColumn("gain", gain).where("gain > 0").groupBy(*keys).agg(F.max_by(stump, F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best"))
        grown = F.when(F.col("best").isNull(), F.col("stumps")).otherwise(F.concat("stumps", F.array("best")))
        models = cut(models.join(best, keys, "left").select(*keys, "n", "base", "edges", grown.alias("stumps")))
    by_value = F.transform("stumps", lambda s: F.struct(s["feature"].alias("feature"), F.get(F.get("edges", s["feature"]), s["bin"]).alias("edge"), s["left"].alias("left"), s["right"].alias("right")))
    return models.select(*keys, "n", "base", by_value.alias("stumps"))


def predict_groups(models: DataFrame, rows: DataFrame, features: Sequence[str], ticker: str = "ticker", sector: str = "sector") -> DataFrame:
    """rows with p and scope: the probability by the most specific model that was trained, the ticker's, the sector's or the
    universal one; none (and no p) without any."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    out = rows
    for s, key in zip(SCOPES, (F.col(ticker), F.col(sector), F.lit("")), strict=True):
        own = models.where(F.col("scope") == s).select(F.col("name").alias(f"{s} model"), F.struct("base", "stumps").alias(f"{s} trees"))
        out = out.join(own, key == F.col(f"{s} model"), "left")
    # each row's one model is chosen before it is applied
    chosen = F.coalesce(*(F.when(F.col(f"{s} model").isNotNull(), F.col(f"{s} trees")) for s in SCOPES))
    scope = F.coalesce(*(F.when(F.col(f"{s} model").isNotNull(), F.lit(s)) for s in SCOPES), F.lit("none"))
    scored = out.withColumn("chosen model", chosen).withColumn("scope", scope)
    p = 1 / (1 + F.exp(-_margin(x, "`chosen model`.")))
    return scored.withColumn("p", p).select(*rows.columns, "scope", "p")


def metrics_by(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, accuracy, brier and auc (by ranks; 0.5 where there is one label) of rows with label and p."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy("p"))
    ties = F.count("*").over(Window.partitionBy(*keys, "p"))
    ranked = scored.withColumn("rank of p", rank + (ties - 1) / 2)
    one = F.sum(F.col("label"))
    zero = F.count("*") - one
    area = F.try_divide(F.sum(F.col("rank of p") * F.col("label")) - one * (one + 1) / 2, one * zero)
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.when((F.col("p") >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"),
        F.coalesce(area, F.lit(0.5)).alias("auc"),
    )
