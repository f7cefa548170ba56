"""Training, keeping and using a model on a small table with a plain rule."""

from __future__ import annotations

import random

from tidemark.ml import train


def labelled_rows(spark):
    rng = random.Random(1)
    rows = [(i, x := rng.uniform(-1, 1), rng.uniform(-1, 1), float(x > 0.1), 1.0, i // 40) for i in range(120)]
    return spark.createDataFrame(rows, "id long, a double, b double, label double, weight double, fold int").coalesce(1)


def test_a_kept_model_predicts_the_same(spark, tmp_path):
    table = labelled_rows(spark)
    models = train.train(table, ["a", "b"])
    train.save(models, str(tmp_path))
    first = {r.id: (r.direction, r.confidence) for r in train.predict(models, table, ["id"]).collect()}
    again = {r.id: (r.direction, r.confidence) for r in train.predict(train.load(str(tmp_path)), table, ["id"]).collect()}
    assert first == again and all(0.5 <= c <= 1 for _, c in first.values())
    assert sum((first[i][0] == "UP") == (label == 1) for i, label in ((r.id, r.label) for r in table.collect())) > 110
    best, tried = train.search(table, ["a", "b"], candidates=2, folds=1, grid={"depth": (1, 2), "trees": (1, 2)})
    assert len(tried) == 2 and best in [way for way, *_ in tried] and all(mean > 0.8 for _, mean, _ in tried)
