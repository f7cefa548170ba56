"""Stored tables: writes by partition, and jobs that end between stage and swap."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators.stored import StoredTable

SCHEMA = "k string, day date, x int"
D = [date(2024, 1, d) for d in range(1, 6)]


def opened(spark, tmp_path):
    return StoredTable(spark, f"{tmp_path}/t", SCHEMA, "day", ["k", "day"])


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def now(table):
    return sorted((r.k, r.day, r.x) for r in table.read().collect())


def files(tmp_path, day):
    return sorted(p.name for p in (tmp_path / "t" / f"day={day}").glob("*.parquet"))


def test_writes_touch_their_partitions_only(spark, tmp_path):
    table = opened(spark, tmp_path)
    assert now(table) == []
    table.delete(F.lit(True))
    table.replace(rows(spark, ("a", D[0], 1), ("b", D[0], 2), ("a", D[1], 3)))
    before = files(tmp_path, D[0])
    table.replace(rows(spark, ("a", D[1], 4), ("c", D[1], 5)))
    assert now(table) == [("a", D[0], 1), ("a", D[1], 4), ("b", D[0], 2), ("c", D[1], 5)]
    assert files(tmp_path, D[0]) == before
    table.insert_ignore(rows(spark, ("a", D[1], 9), ("d", D[2], 1), ("d", D[2], 0)), [F.col("x")])
    table.update(spark.createDataFrame([("b", D[0], None), ("a", D[0], 7), ("z", D[0], 1)], SCHEMA))
    assert now(table) == [("a", D[0], 7), ("a", D[1], 4), ("b", D[0], 2), ("c", D[1], 5), ("d", D[2], 0)]
    table.append(rows(spark, ("d", D[2], 0)))
    assert now(table)[-2:] == [("d", D[2], 0)] * 2
    table.delete(F.col("k") == "d", F.col("x") == 4, F.lit(None).cast("boolean"))
    assert now(table) == [("a", D[0], 7), ("b", D[0], 2), ("c", D[1], 5)]
    assert not (tmp_path / "t" / f"day={D[2]}").exists()
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_job_that_fails_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = opened(spark, tmp_path)
    table.replace(rows(spark, ("a", D[0], 1), ("a", D[1], 1)))

    def killed(*_):
        raise KeyboardInterrupt

    # between stage and swap: what was staged whole is swapped in when the table is opened again
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(table, "_swap", killed)
        table.replace(rows(spark, ("a", D[0], 2), ("b", D[3], 2)))
    assert now(table) == [("a", D[0], 1), ("a", D[1], 1)]
    assert now(opened(spark, tmp_path)) == [("a", D[0], 2), ("a", D[1], 1), ("b", D[3], 2)]

    # while it stages: nothing of it stays
    with pytest.raises(Exception, match="stops here"):
        table.replace(rows(spark, ("a", D[0], 3)).withColumn("x", F.when(F.col("x") == 3, F.raise_error(F.lit("stops here"))).otherwise(F.col("x")).cast("int")))
    (tmp_path / "t.stage-half" / f"day={D[0]}").mkdir(parents=True)
    table = opened(spark, tmp_path)
    assert now(table) == [("a", D[0], 2), ("a", D[1], 1), ("b", D[3], 2)] and [p.name for p in tmp_path.iterdir()] == ["t"]

    # in the middle of a swap, after any number of renames
    for stop in range(1, 6):
        want = [("a", D[0], 10 + stop), ("a", D[1], 1), ("b", D[3], 2), ("c", D[4], stop)]
        left = [stop]

        def rename(old, new, own=table._rename, left=left):
            left[0] -= 1
            if not left[0]:
                raise OSError("killed")
            own(old, new)

        with monkeypatch.context() as m:
            m.setattr(table, "_rename", rename)
            try:
                table.replace(rows(spark, ("a", D[0], 10 + stop), ("c", D[4], stop)))
            except OSError:
                pass
        table = opened(spark, tmp_path)
        assert now(table) == want
