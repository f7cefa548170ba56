"""Walk-forward training of boosted trees with calibrated probabilities."""

from __future__ import annotations

import random
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def fit(rows: DataFrame, features: list[str], depth: int = 2, trees: int = 5, seed: int = 5):
    """Trees on the weighted rows."""
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    trees_of = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxDepth=depth, maxIter=trees, seed=seed)
    return Pipeline(stages=[assemble, trees_of]).fit(rows)


def raw_scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("raw_score", vector_to_array("rawPrediction")[1])


def calibrate(scored: DataFrame):
    """Platt scaling: a logistic curve over the raw scores of rows that the trees did not see."""
    return Pipeline(stages=[VectorAssembler(inputCols=["raw_score"], outputCol="score_vector"), LogisticRegression(labelCol="label", featuresCol="score_vector", probabilityCol="calibrated", rawPredictionCol="calibrated_raw", predictionCol="calibrated_class")]).fit(scored)


def metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and Brier score of columns label and p; the area under the curve is 0.5 for one class."""
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.when((F.col("p") >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)).alias("accuracy"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.count_distinct("label").alias("classes"))
    area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="p").evaluate(rows)
    return totals.withColumn("auc", F.when(F.col("classes") == 2, F.lit(area)).otherwise(0.5)).drop("classes")


def walk_forward(rows: DataFrame, features: list[str], folds: int = 3, depth: int = 2, trees: int = 5) -> DataFrame:
    """Metrics of each fold k: trained on the folds before it, calibrated on the newest of them.

    rows: features, label, weight and fold (0 is only trained on).  The loop runs over
    folds, a fixed number; each step is a Spark job over all tickers.
    """
    out = []
    rows = cut(rows)
    for fold in range(1, folds + 1):
        train, test = rows.where(F.col("fold") < fold), rows.where(F.col("fold") == fold)
        model = fit(train, features, depth, trees)
        held = raw_scores(model, train.where(F.col("fold") == fold - 1)) if fold > 1 else raw_scores(model, train)
        scored = calibrate(held).transform(raw_scores(model, test)).withColumn("p", vector_to_array("calibrated")[1])
        out.append(metrics(scored.select("label", "p")).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, out)


#: Settings that the search draws from.
GRID = {"depth": (2, 3, 4), "trees": (5, 10, 20)}


def search(rows: DataFrame, features: list[str], candidates: int = 5, folds: int = 3, seed: int = 5, grid: dict[str, tuple] = GRID) -> tuple[dict, list[tuple[dict, float, float]]]:
    """The best of some settings drawn from the grid, by mean accuracy over the walk-forward folds;
    and each setting's mean and standard deviation.  The driver loops over settings and folds,
    which are few; every step is a Spark job."""
    ways = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    tried = []
    for way in random.Random(seed).sample(ways, min(candidates, len(ways))):
        r = walk_forward(rows, features, folds, **way).agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("deviation")).first()
        tried.append((way, r["mean"], r["deviation"]))
    return max(tried, key=lambda t: t[1])[0], tried


def train(rows: DataFrame, features: list[str], depth: int = 2, trees: int = 5) -> tuple:
    """The trees and their calibration, on the rows before the last fold and on that fold."""
    newest = rows.agg(F.max("fold")).first()[0]
    model = fit(rows.where(F.col("fold") < newest), features, depth, trees)
    return model, calibrate(raw_scores(model, rows.where(F.col("fold") == newest)))


def save(models: tuple, path: str) -> None:
    """Both parts, below a path that all executors reach; an older model there is replaced."""
    for part, model in zip(("trees", "calibration"), models, strict=True):
        model.write().overwrite().save(f"{path}/{part}")


def load(path: str) -> tuple:
    return tuple(PipelineModel.load(f"{path}/{part}") for part in ("trees", "calibration"))


def predict(models: tuple, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, direction (UP from 0.5 on) and confidence, the probability of the direction."""
    model, calibration = models
    p = vector_to_array("calibrated")[1]
    scored = calibration.transform(raw_scores(model, rows)).select(*keys, p.alias("p"))
    return scored.select(*keys, F.when(F.col("p") >= 0.5, "UP").otherwise("DOWN").alias("direction"), F.greatest("p", 1 - F.col("p")).alias("confidence"))
