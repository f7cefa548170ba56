"""Records merged into entities, against the loop that takes them one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_company
from tidemark.operators.entities import merge_listings

OLD = "id long, company_name string, ticker string, status string, sector string, valuation string, source string"
NEW = "n long, " + OLD.removeprefix("id long, ")


def one_by_one(spark, old, new):
    names = sorted({r[1] or "" for r in old} | {r[1] or "" for r in new})
    form = dict(zip(names, (r.f for r in spark.createDataFrame(list(enumerate(names)), "i int, t string").select("i", normalize_company(F.col("t")).alias("f")).orderBy("i").collect()), strict=True))
    rows = [list(r) for r in sorted(old)]
    for _, name, ticker, status, sector, valuation, source in sorted(new):
        mine = next((r for r in rows if r[1] is not None and r[1] == name), None)
        if mine is None and form[name or ""]:
            mine = next((r for r in rows if form[r[1] or ""] == form[name]), None)
        if mine is None and not form[name or ""]:
            mine = next((r for r in rows if r[0] is None and (r[1] or "") == (name or "")), None)
        if mine is None:
            rows.append([None, name, ticker, status, sector, valuation, source])
        elif mine[6] == "finnhub" and source != "finnhub":
            mine[4], mine[5] = sector or mine[4], valuation or mine[5]
        else:
            mine[2:6] = [ticker, status, sector, valuation]
            mine[6] = source or mine[6]
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_merging_is_taking_them_one_by_one(spark, seed):
    rng = random.Random(seed)
    forms = ["", ", Inc.", " Corp", " Holdings Ltd", " co"]
    name = lambda: rng.choice(["Apnimed", "Bolt", "Čez", "Delta Air", "Echo", "!!"]) + rng.choice(forms)
    maybe = lambda x: x if rng.random() < 0.6 else None
    body = lambda k: (maybe(f"T{k}"), maybe(f"st{k}"), maybe(f"se{k}"), maybe(f"v{k}"), rng.choice(["finnhub", "llm", None, None]))
    old = [(i, rng.choice([name(), name(), "Zed"]), *body(f"o{i}")) for i in range(6)]
    new = [(n, rng.choice([name(), name(), name(), old[2][1], None]), *body(n)) for n in range(40)]
    got = merge_listings(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW).repartition(3), "n").collect()
    assert sorted(map(tuple, got), key=str) == one_by_one(spark, old, new)


def test_nothing_new_and_nothing_old(spark):
    old = [(1, "A", "t", "s", None, None, None)]
    assert merge_listings(spark.createDataFrame(old, OLD), spark.createDataFrame([], NEW), "n").collect() == old
    new = [(1, "A Inc", None, "s", None, "v", "llm"), (2, "A", "t", "s2", None, None, None)]
    assert [tuple(r) for r in merge_listings(spark.createDataFrame([], OLD), spark.createDataFrame(new, NEW), "n").collect()] == [(None, "A Inc", "t", "s2", None, None, "llm")]
