"""Operators on embeddings (11, 13), against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import ordered
from tidemark.llm import codes, negatives, registry
from tidemark.llm.vectors import whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(seed=5, n=240, length=16):
    """Clustered vectors with nulls, ties, copies, repeated rows and odd lengths."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(length)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([0, 1, 1, 1, 2, None])) for i in range(n)]
    rows += [(1000 + 50 * k, rows[7][1], 1) for k in range(12)]  # copies, anchors too
    rows += [rows[50], rows[50], rows[3]]  # repeated rows, one of them an anchor
    rows += [(2000, None, 1), (2001, [None] * length, 1), (2050, [float("nan")] * length, 1), (2051, [math.inf] + [0.0] * (length - 1), 2)]
    rows += [(2100, [0.5] * (length - 2), 1), (2150, [], 2), (None, rows[9][1], 1), (None, rows[10][1], 0)]
    return rows


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "row", "code", "list", "rank", "a.b", "rows of label"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.repartition(3)


def kept(rows, multiple=1):
    able = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max((len(v) for _, v, _ in able), default=0)
    length = max(-(-length // multiple) * multiple, multiple)
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (length - len(v)), label) for i, v, label in able]


# --- 11: vector codes


def brute_codes(rows, parts, entries, rounds):
    own = kept(rows, parts)
    width = len(own[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in own]
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(own, code, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    code = assign()
    return [(i, c, sum(far(cut(v, p), books[p][c[p]]) for p in range(parts))) for (i, v, _), c in zip(own, code, strict=True)], books


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 9, 3), (16, 64, 2), (1, 1, 1), (4, 400, 2)])
def test_codes_are_lloyds(spark, parts, entries, rounds):
    rows = rows_of()
    coded, books = codes.quantize(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    wanted, want_books = brute_codes(rows, parts, entries, rounds)
    assert books.entries.tolist() == want_books
    assert ordered((r.vec_id, r.error, *r.code) for r in coded.collect()) == ordered((i, e, *c) for i, c, e in wanted)


def test_bounds_spare_comparisons_and_keep_ties():
    rng = np.random.default_rng(4)
    centres = rng.integers(-90, 90, (8, 4))
    v = (centres[rng.integers(0, 8, 3000)] + rng.integers(-9, 9, (3000, 4))).astype(np.int64)
    v[:200] = v[0]
    then = codes.Codebooks(np.concatenate([centres, centres[:1]])[None].astype(np.int64))  # the last entry ties with the first
    state = codes.first_codes(v, then)
    now = codes.Codebooks(then.entries + rng.integers(-2, 3, then.entries.shape))
    code, upper, lower, compared = codes.next_codes(v, *state, now, then)
    whole = codes.first_codes(v, now)
    assert (code == whole[0]).all() and 0 < compared < len(v) // 2
    same = codes.next_codes(v, *state, then, then)
    assert (same[0] == state[0]).all() and not (same[0] == 8).any()
    far = np.sqrt(((v[:, None] - now.entries[0]) ** 2).sum(axis=2))
    assert (upper[:, 0] >= far[np.arange(len(v)), code[:, 0]]).all()
    far[np.arange(len(v)), code[:, 0]] = np.inf
    assert (lower[:, 0] <= far.min(axis=1)).all()


def test_codes_query(spark, tmp_path):
    rows = rows_of()
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted, books = brute_codes(rows, 16, 64, 2)
    labels = {}
    for (_, _, e), (_, _, label) in zip(wanted, kept(rows), strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = registry.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    assert ordered((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == ordered((i, "".join(f"{x:02x}" for x in c), e, labels[label], sha) for (i, c, e), (_, _, label) in zip(wanted, kept(rows), strict=True))


def test_no_vectors(spark, tmp_path):
    frame(spark, [(1, None, 1), (2, [float("nan")], 0)]).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    for d in "ab":
        for name in ("op11_vector_codes", "op13_hard_negatives"):
            assert registry.QUERIES[name](spark, f"{tmp_path}/{d}").collect() == []


def test_large_components_are_held(spark):
    rows = [(0, [3e38, -3e38, 1.0], 0), (1, [0.0, 1e9], 1)]
    got, length = whole_numbers(frame(spark, rows), "embedding", 2)
    v = {r.vec_id: r.v for r in got.collect()}
    assert length == 4 and v[0][2:] == [256, 0] and v[0][0] == -v[0][1] == v[1][1] and 4 * v[0][0] ** 2 <= 1 << 55


# --- 13: hard negatives


def brute_negatives(rows):
    own = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if label is not None]
    own = kept(own)
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is None or i % 50:
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for b, (j, w, other) in enumerate(own) if b != a]
        for p, j, _ in sorted((s for s in score if s[2]), key=order)[:5]:
            bad = sorted((s for s in score if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(bad)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_exact(spark, tmp_path, monkeypatch, small):
    """small: many lists and blocks, few visits in a round, anchors in shares."""
    if small:
        for name, value in (("VISITS", 1), ("BLOCK", 8), ("ANCHORS", 4), ("TILE", 2), ("SAMPLE", 60)):
            monkeypatch.setattr(negatives, name, value)
    rows = rows_of()
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = brute_negatives(rows)
    assert len(wanted) > 50
    assert ordered(tuple(r[c] for c in columns) for r in got) == ordered(wanted)


def test_lists_out_of_reach_are_not_visited(spark):
    """Two far clusters: anchors of one never visit the other's lists for their best rows."""
    rng = random.Random(1)
    rows = [(i, [(20.0 if i % 2 else -20.0) * (k == 0) + rng.gauss(0, 0.05) for k in range(8)], 0) for i in range(400)]
    own, length = whole_numbers(frame(spark, rows), "embedding")
    lists, *index = negatives.indexed(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), own["v"]), length)
    anchors = lists.where("vec_id % 50 = 0").select("row", "label", "v", F.array(F.lit(1)).cast("array<bigint>").alias("low"), F.array(F.lit(1 << 60)).alias("high"))
    visits = negatives._visits(anchors, length, *index, 0, 10**6, 1)
    sides = {r.list for r in visits.select("list").distinct().collect()}
    assert sides and all(index[0][s][0] < 0 for s in sides)


def test_products_beyond_floats():
    a = np.array([[(1 << 27) + 1, 3]], dtype=np.int64)
    assert negatives.products(a, a).tolist() == [[((1 << 27) + 1) ** 2 + 9]]
