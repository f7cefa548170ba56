"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from tidemark.plans.base import TABLES
from tidemark.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def by_text(row):
    return tuple((x is None, str(x)) for x in row)


def same(a, b) -> bool:
    """Sums differ in their last digits by the order of adding; all are rounded to six places or so."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=by_text)
    if name not in ORACLE:
        assert rows
        return
    cursor = duck.execute(ORACLE[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=by_text)
    assert len(rows) == len(wanted)
    assert all(same(x, y) for a, b in zip(rows, wanted, strict=True) for x, y in zip(a, b, strict=True))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
