"""Models of many groups at once, against a brute-force fit of each group on its own."""

from __future__ import annotations

import math
import random

import pytest

from tidemark.ml import boosting

FEATURES = ["a", "b", "c"]


def sample():
    rng = random.Random(3)
    rows = []
    for t, n in (("T1", 120), ("T2", 90), ("T3", 12), ("T4", 60), (None, 25)):
        for _ in range(n):
            a, b, c = rng.uniform(-1, 1), rng.choice([0.0, 1.0, 2.0, None]), rng.gauss(0, 1)
            up = (a > 0.2) if t == "T1" else ((b or 0) >= 1) if t == "T2" else (c > 0)
            label = 1.0 if t == "T4" else float(up ^ (rng.random() < 0.1))
            rows.append((t, {"T1": "S1", "T2": "S1", "T3": "S2", "T4": None}.get(t, "S2"), a, b, c, label, rng.uniform(0.5, 1.5)))
    return rows


SCHEMA = "ticker string, sector string, a double, b double, c double, label double, weight double"


def brute(rows, rounds, bins, rate):
    """Base and stumps of one group; rows: (features, label, weight)."""
    edges = []
    for f in range(3):
        own = sorted(x[f] for x, _, _ in rows if x[f] is not None)
        edges.append(sorted({own[max(math.ceil(k / bins * len(own)) - 1, 0)] for k in range(1, bins)}))
    one, all_ = sum(w * y for _, y, w in rows), sum(w for *_, w in rows)
    base = math.log(one / (all_ - one))
    margin = [base] * len(rows)
    stumps = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [w * (q - y) for q, (_, y, w) in zip(p, rows, strict=True)]
        h = [w * q * (1 - q) for q, (*_, w) in zip(p, rows, strict=True)]
        best = None
        for f in range(3):
            place = [0 if x[f] is None else sum(e < x[f] for e in edges[f]) for x, _, _ in rows]
            for k in sorted(set(place))[:-1]:
                left = [i for i, b in enumerate(place) if b <= k]
                gl, hl, ga, ha = sum(g[i] for i in left), sum(h[i] for i in left), sum(g), sum(h)
                gain = round(gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, edges[f][k], -rate * gl / (hl + 1), -rate * (ga - gl) / (ha - hl + 1), set(left)
        if best is None:
            break
        stumps.append(best[1:5])
        margin = [m + (best[3] if i in best[5] else best[4]) for i, m in enumerate(margin)]
    return base, stumps, margin


def test_every_group_learns_as_it_would_alone(spark):
    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    models = boosting.fit_groups(boosting.in_scopes(table), FEATURES, rounds=6, bins=8, rate=0.3)
    got = {(r["scope"], r["name"]): r for r in models.collect()}
    wanted = {("ticker", t): [r for r in rows if r[0] == t] for t in ("T1", "T2")} | {("sector", s): [r for r in rows if r[1] == s] for s in ("S1", "S2")} | {("universal", ""): rows}
    assert set(got) == set(wanted)  # T3 is too short, T4 has one label
    margins = {}
    for key, own in wanted.items():
        base, stumps, margin = brute([((r[2], r[3], r[4]), r[5], r[6]) for r in own], 6, 8, 0.3)
        assert got[key].n == len(own) and got[key].base == pytest.approx(base)
        assert [(s.feature, s.edge) for s in got[key].stumps] == [(f, e) for f, e, *_ in stumps]
        assert [x for s in got[key].stumps for x in (s.left, s.right)] == pytest.approx([x for s in stumps for x in s[2:]])
        margins[key] = dict(zip(own, margin, strict=True))

    scored = boosting.predict_groups(models, table, FEATURES).collect()
    assert len(scored) == len(rows)
    for r in scored:
        row = tuple(r)[:7]
        key = next(k for k in (("ticker", r.ticker), ("sector", r.sector), ("universal", "")) if k in wanted)
        assert r["scope"] == key[0] and r.p == pytest.approx(1 / (1 + math.exp(-margins[key][row])))
    found = {r.ticker: r for r in boosting.metrics_by(boosting.predict_groups(models, table, FEATURES), ["ticker"]).collect()}
    own = [r for r in scored if r.ticker == "T1"]
    assert found["T1"].accuracy == sum((r.p >= 0.5) == (r.label == 1) for r in own) / len(own) > 0.8
    assert found["T1"].brier == pytest.approx(sum((r.p - r.label) ** 2 for r in own) / len(own))
    pairs = [(x.p > y.p) + (x.p == y.p) / 2 for x in own if x.label for y in own if not y.label]
    assert found["T1"].auc == pytest.approx(sum(pairs) / len(pairs)) and found["T4"].auc == 0.5


def test_no_model_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    models = boosting.fit_groups(boosting.in_scopes(empty), FEATURES, rounds=1)
    assert models.count() == 0
    one = spark.createDataFrame(sample()[:1], SCHEMA)
    assert [(r["scope"], r.p) for r in boosting.predict_groups(models, one, FEATURES).collect()] == [("none", None)]
