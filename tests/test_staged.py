"""The staged cycle over several batches: nothing lost, nothing twice, limits held, attempts counted."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.staged import Stage, StagedCycle

T = datetime(2024, 1, 1)
SCHEMA = "id long, day date, at timestamp, text string, kind string, score double"


def made(spark, tmp_path, log, limits=(5, 3), **more):
    def classify(rows):
        log.append(("classify", sorted(r.id for r in rows.collect())))
        return rows.where("id % 7 <> 3").select("id", "day", F.concat(F.lit("k"), F.col("id") % 3).alias("kind"))  # no answer for each seventh

    def rank(rows):
        log.append(("rank", sorted(r.id for r in rows.collect())))
        assert rows.where("kind is null").count() == 0
        return rows.select("id", "day", (F.col("id") * 0.5).alias("score"))

    return StagedCycle(spark, str(tmp_path / "root"), SCHEMA, "id", "day", "at", [Stage("classify", limits[0], classify), Stage("rank", limits[1], rank)], **more)


def batch(spark, *ids):
    rows = [(i, T + timedelta(hours=7 * i)) for i in ids]
    return spark.createDataFrame([(i, t.date(), t, f"t{i}") for i, t in rows], "id long, day date, at timestamp, text string")


def test_no_row_is_lost_or_comes_twice(spark, tmp_path):
    log = []
    cycle = made(spark, tmp_path, log)
    cycle.land(batch(spark, *range(8)))
    assert cycle.step() == 5 + 3  # four of the first five are answered, and three of these ranked
    assert log == [("classify", [0, 1, 2, 3, 4]), ("rank", [0, 1, 2])]
    cycle = made(spark, tmp_path, log)  # opened again
    cycle.land(batch(spark, 6, 7, 8, 9, 9))  # two are there already
    cycle.drain()
    rows = {r.id: r for r in cycle.rows.read().collect()}
    assert sorted(rows) == list(range(10)) and cycle.rows.read().count() == 10
    assert all((r.kind, r.score) == ((None, None) if i == 3 else (f"k{i % 3}", i * 0.5)) for i, r in rows.items())
    assert all(len(ids) <= {"classify": 5, "rank": 3}[stage] for stage, ids in log)
    tries = [i for stage, ids in log if stage == "classify" for i in ids]
    assert sorted(tries) == sorted([*range(10), 3, 3])  # the one without an answer three times
    assert sorted(i for stage, ids in log if stage == "rank" for i in ids) == [i for i in range(10) if i != 3]
    assert cycle.backlog.read().count() == 0 and cycle.step() == 0


def test_a_broken_cycle_goes_on(spark, tmp_path, monkeypatch):
    """A job that ends between a stage's result and its backlog does the stage once more, to the same end."""
    log = []
    cycle = made(spark, tmp_path, log, (9, 9))
    cycle.land(batch(spark, 1, 2))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(cycle.backlog, "overwrite", killed)
        cycle.step()
    cycle = made(spark, tmp_path, log, (9, 9))
    cycle.drain()
    assert sorted((r.id, r.kind, r.score) for r in cycle.rows.read().collect()) == [(1, "k1", 0.5), (2, "k2", 1.0)]


def test_late_rows_within_the_overlap_come_too(spark, tmp_path):
    cycle = made(spark, tmp_path, [])
    asked = []

    def read(since):
        asked.append(since)
        return there if since is None else there.where(F.col("at") >= F.lit(since))

    there = batch(spark, 10, 20, 30)
    cycle.resume("filings", read)
    there = batch(spark, 1, 10, 15, 20, 30, 31)  # 1 and 15 are late, 1 by more than the overlap
    cycle.resume("filings", read)
    cycle.resume("other", lambda since: batch(spark))
    assert asked == [None, T + timedelta(hours=210) - timedelta(days=5)]
    assert sorted(r.id for r in cycle.rows.read().collect()) == [10, 15, 20, 30, 31]
    assert [(r.source, r.read_to) for r in cycle.seen.read().collect()] == [("filings", T + timedelta(hours=217))]
