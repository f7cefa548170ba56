from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, knn, upsert
from tidemark.operators.ewm import SEGMENT, ewm_mean
from tidemark.operators.topk import nth_per_group, top_per_group
from tidemark.schemas import KEYS, SCHEMAS


def test_ewm_is_the_recursion_beyond_a_segment(spark):
    rng = random.Random(1)
    values = [rng.uniform(1, 100) for _ in range(2 * SEGMENT + 50)]
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)] + [("B", 0, 5.0)], "k string, i int, v double")
    found = {r.i: r.e for r in ewm_mean(rows, "v", ["k"], ["i"], 26, "e").where("k = 'A'").collect()}
    wanted = pd.Series(values).ewm(span=26, adjust=False).mean()
    assert max(abs(found[i] - w) for i, w in enumerate(wanted)) < 1e-8


def test_asof_takes_the_newest_not_later(spark):
    t = datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", t), ("a", t + timedelta(days=2)), ("a", t + timedelta(days=9)), ("b", t)], "k string, t timestamp")
    right = spark.createDataFrame([("a", t, 1), ("a", t, 2), ("a", t + timedelta(days=3), 3), ("c", t, 4)], "k string, u timestamp, v int")
    found = {(r.k, r.t): r.v for r in asof.asof_join(left, right, "k", "t", "u", ["v"], "v").collect()}
    assert found == {("a", t): 2, ("a", t + timedelta(days=2)): 2, ("a", t + timedelta(days=9)): 3, ("b", t): None}


def test_asof_features_do_not_see_the_future(spark):
    t = datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", t + timedelta(days=d)) for d in range(5)], "k string, t timestamp")
    past = [("a", t + timedelta(days=d), d) for d in range(5)]
    seen = asof.asof_join(left, spark.createDataFrame(past, "k string, u timestamp, v int"), "k", "t", "u", ["v"], "v").collect()
    later = asof.asof_join(left, spark.createDataFrame([*past, ("a", t + timedelta(days=99), 99)], "k string, u timestamp, v int"), "k", "t", "u", ["v"], "v").collect()
    assert sorted(seen) == sorted(later)


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(2)
    t = datetime(2024, 1, 1)
    a = [(i, t + timedelta(hours=rng.randrange(400))) for i in range(40)]
    b = [(i, t + timedelta(hours=rng.randrange(400))) for i in range(40)]
    found = asof.band_join(spark.createDataFrame(a, "a int, t timestamp"), spark.createDataFrame(b, "b int, u timestamp"), "t", "u", 3)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((i, j) for i, x in a for j, y in b if abs(x - y) <= timedelta(days=3))


def test_upserts(spark):
    schema = "k int, v string, source string"
    old = spark.createDataFrame([(1, "a", "api"), (2, None, "api"), (3, "c", "llm")], schema)
    new = spark.createDataFrame([(2, "x", "llm"), (3, "y", "api"), (4, "z", "llm")], schema)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(upsert.replace(old, new, ["k"])) == {(1, "a", "api"), (2, "x", "llm"), (3, "y", "api"), (4, "z", "llm")}
    assert as_set(upsert.insert_ignore(old, new, ["k"], [F.col("v")])) == {(1, "a", "api"), (2, None, "api"), (3, "c", "llm"), (4, "z", "llm")}
    assert as_set(upsert.precedence(old, new, ["k"], "source", {"api": 2, "llm": 1}, ["v"])) == {(1, "a", "api"), (2, "x", "api"), (3, "y", "api"), (4, "z", "llm")}
    assert as_set(upsert.coalesce_update(old, new.select("k", "v"), ["k"])) == {(1, "a", "api"), (2, "x", "api"), (3, "y", "llm")}
    assert as_set(upsert.delete_where(old, F.col("v") == "a")) == {(2, None, "api"), (3, "c", "llm")}


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    once = upsert.replace(old, new, ["k"])
    assert sorted(upsert.replace(once, new, ["k"]).collect()) == sorted(once.collect())


def test_top_and_nth(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, v int")
    assert sorted((r.k, r.v) for r in top_per_group(rows, ["k"], [F.desc("v")], 2).collect()) == [("a", 3), ("a", 4), ("b", 1)]
    assert [(r.k, r.v) for r in nth_per_group(rows, ["k"], [F.desc("v")], 4).collect()] == [("a", 1)]


def test_nearest_in_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4), (100, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(knn, "BLOCK", 3)
    found = knn.nearest(vectors, vectors.where("id < 10"), 5).collect()
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    for i, v in rows[:10]:
        wanted = sorted(((-cosine(v, w), j) for j, w in rows[:60]))[:5]
        assert [r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)] == [j for _, j in wanted]
    assert knn.nearest(vectors, vectors.where("id < 0"), 5).count() == 0
    assert knn.nearest(vectors.where("id < 0"), vectors, 5).count() == 0


def clustered(seed=8, n=150, length=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)], datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 600))) for i in range(n)]
    rows += [(200 + k, rows[3][1], rows[3][2] + timedelta(days=k)) for k in range(5)] + [(300, rows[3][1], rows[3][2])]  # copies, at one time too
    return [*rows, (400, [0.0] * length, rows[0][2]), (401, None, rows[0][2]), (402, rows[0][1], None)]


def likeness(v, w):
    return sum(a * b for a, b in zip(v, w, strict=True)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5


def test_lists_out_of_reach_lose_no_neighbour(spark, monkeypatch):
    """Many lists, of which the first round visits one, in blocks of a few rows."""
    rows = clustered()
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, published_at timestamp").repartition(3)
    for name, value in (("BLOCK", 7), ("FIRST", 1), ("TILE", 4)):
        monkeypatch.setattr(knn, name, value)
    found = {}
    for r in knn.nearest(vectors, vectors.where("id % 5 = 0"), 6).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id))
    able = {i: v for i, v, _ in rows if v and any(v)}
    wanted = {i: [(k, j) for k, (_, j) in enumerate(sorted((-round(likeness(v, w), 9), j) for j, w in able.items())[:6], 1)] for i, v in able.items() if i % 5 == 0}
    assert {i: sorted(x) for i, x in found.items()} == wanted
    table, lists = knn.index(knn.unit_rows(vectors, "id", "embedding"))
    assert len(lists.radius) > 5 and table.count() == len(able)
    asked = knn.unit_rows(vectors.where("id % 5 = 0"), "id", "embedding")
    assert knn._visiting(asked, lists, lambda _, bounds: bounds > 0.9).count() < asked.count() * len(lists.radius) / 2


def dealt_rows(monkeypatch, vectors, key):
    """Frames that are dealt by that key among others, as they come."""
    kind, found = type(vectors), []
    repartition = kind.repartition

    def noted(self, *by):
        if key in by:
            found.append(self)
        return repartition(self, *by)

    monkeypatch.setattr(kind, "repartition", noted)
    return found


@pytest.mark.parametrize("n", [200, 800])
def test_sparse_bands_are_dealt_in_proportion(spark, monkeypatch, n):
    """A row an hour, so 72 in a band, however many rows there are: each is written once and visits two bands."""
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(n)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, published_at timestamp")
    monkeypatch.setattr(knn, "BLOCK", 100)
    dealt = dealt_rows(monkeypatch, vectors, "band")
    got = {r.id: r.other for r in knn.nearest_in_band(vectors, 0.35, 3, True).collect()}
    assert sum(x.count() for x in dealt) <= 3 * n
    near = {i: max(((round(likeness(v, rows[j][1]), 9), -j) for j in range(max(0, i - 72), i)), default=(0, 0)) for i, v, _ in rows}
    assert got == {i: -j for i, (x, j) in near.items() if x > 0.35}


def test_dense_bands_are_dealt_by_blocks(spark, monkeypatch):
    """All rows within one band, out of reach of no list: a row comes for half a block of rows or more, and once more where a long list is cut."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(900)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, published_at timestamp")
    monkeypatch.setattr(knn, "BLOCK", 300)
    dealt = dealt_rows(monkeypatch, vectors, "block")
    got = {r.id: r.other for r in knn.nearest_in_band(vectors, 0.8, 3, False).collect()}
    assert sum(x.count() for x in dealt) <= len(rows) * (1 + 1 + 2 * len(rows) / 150)
    near = {i: max(((round(likeness(v, rows[j][1]), 9), -j) for j in range(i + 1, 900)), default=(0, 0)) for i, v, _ in rows}
    assert got == {i: -j for i, (x, j) in near.items() if x > 0.8}


def test_queries_come_once_for_a_block(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    for name, value in (("BLOCK", 300), ("FIRST", 1)):
        monkeypatch.setattr(knn, name, value)
    dealt = dealt_rows(monkeypatch, vectors, "block")
    found = knn.nearest(vectors, vectors.where("id % 9 = 0"), 5).collect()
    assert sum(x.where("comes").count() for x in dealt) <= 100 * 2 * 900 / 150
    for i in range(0, 900, 90):
        wanted = sorted((-round(likeness(rows[i][1], w), 9), j) for j, w in rows)[:5]
        assert [r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)] == [j for _, j in wanted]


@pytest.mark.parametrize("block", [4096, 7])
def test_duplicates_are_those_of_the_loop(spark, monkeypatch, block):
    """Rows are taken oldest first; each looks for its nearest fellow within three days, either way, that
    isn't flagged itself, and is flagged if that is near enough."""
    from tidemark.plans import retrieval

    monkeypatch.setattr(knn, "BLOCK", block)
    rows = clustered()
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, published_at timestamp").repartition(3)
    able = sorted((t, i, v) for i, v, t in rows if v and any(v) and t)
    flagged = {}
    for t, i, v in able:
        near = [(round(likeness(v, w), 9), -j) for u, j, w in able if j != i and j not in flagged and abs(u - t) <= timedelta(days=3)]
        best = max(near, default=(0, 0))
        if best[0] > 0.9:
            flagged[i] = -best[1]
    got = {r.id: r.duplicate_of for r in retrieval.duplicates(vectors, "greedy", 0.9).collect()}
    assert len(got) > 30 and got == flagged
    before = {}
    for t, i, v in able:
        near = [(round(likeness(v, w), 9), -j) for u, j, w in able if (u, j) < (t, i) and t - u <= timedelta(days=3)]
        if max(near, default=(0, 0))[0] > 0.9:
            before[i] = -max(near)[1]
    assert {r.id: r.duplicate_of for r in retrieval.duplicates(vectors, "earliest", 0.9).collect()} == before


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schemas(spark, name):
    empty = spark.createDataFrame([], SCHEMAS[name])
    assert set(KEYS[name]) <= set(empty.columns)


def test_insert_new_is_row_by_row(spark):
    """Against inserts one by one into a table with two unique keys."""
    rng = random.Random(5)
    for _ in range(4):
        old = [(i, f"u{rng.randint(0, 9)}") for i in rng.sample(range(12), 3)]
        old = list({u: (i, u) for i, u in old}.values())
        new = [(rng.choice([None, *range(12)]), rng.choice([None, *(f"u{k}" for k in range(10))]), n) for n in range(14)]
        ids, urls, wanted = {i for i, _ in old}, {u for _, u in old}, []
        for i, u, n in new:
            if i not in ids and u not in urls:
                wanted.append(n)
                ids |= {i} - {None}
                urls |= {u} - {None}
        got = upsert.insert_new(spark.createDataFrame(old, "id long, url string"), spark.createDataFrame(new, "id long, url string, n long"), ["id", "url"], [F.col("n")])
        assert sorted(r.n for r in got.collect()) == wanted
    known = upsert.insert_new(spark.createDataFrame([(1, "u1")], "id long, url string"), spark.createDataFrame([(5, "u1", 1), (5, "u5", 2)], "id long, url string, n long"), ["id", "url"], [F.col("n")])
    assert [(r.id, r.url) for r in known.collect()] == [(5, "u5")]


def test_the_last_of_equal_keys_replaces(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n long")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 3)], "k long, v string, n long")
    assert sorted((r.k, r.v) for r in upsert.replace(old, new, ["k"], [F.desc("n")]).collect()) == [(1, "d"), (2, "b"), (3, "e")]


def test_settings_and_watchlist(spark):
    from tidemark.plans import settings

    there = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    wanted = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, fallback string")
    assert {r.key: r.value for r in settings.read_settings(there, wanted).collect()} == {"a": "1", "b": "y", "c": "z"}
    watched = spark.createDataFrame([("AAPL",), ("MSFT",)], "symbol string")
    more = settings.watch(watched, spark.createDataFrame([("aapl",), ("nvda",), ("NVDA",)], "symbol string"))
    assert sorted(r.symbol for r in more.collect()) == ["AAPL", "MSFT", "NVDA"]
    assert [r.symbol for r in settings.unwatch(watched, spark.createDataFrame([("msft",), ("gone",)], "symbol string")).collect()] == ["AAPL"]


def test_batches_are_counted_and_a_model_trains_after_it(spark, tmp_path):
    """Two files, two batches, two rows of counters; in the same session a model is fitted and used."""
    from tests.test_train import labelled_rows
    from tidemark.ml import train
    from tidemark.streaming.counters import CounterTable, counted, observed

    schema = "event_type string, importance_score double"
    for rows in ([("general", 1.0), ("noise", None), (None, None)], [("general", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    kept = CounterTable(spark, f"{tmp_path}/counters")
    counted(stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True), kept)
    found = kept.read().orderBy("batch_id").collect()
    assert sorted(tuple(r.counters[c] for c in ("fetched", "classified", "ranked")) for r in found) == [(1, 1, 0), (3, 2, 1)]
    assert [r.batch_id for r in found] == [0, 1] and all(r.recorded_at and r.duration_ms >= 0 for r in found)
    observed(spark.createDataFrame([("general", 1.0)], schema), "batch").count()
    table = labelled_rows(spark)
    assert train.predict(train.train(table, ["a", "b"]), table, ["id"]).count() == 120


def test_countries_by_a_given_gazetteer(spark):
    """Cities, demonyms and short names that count in capitals only; every name by itself."""
    from tidemark.plans.articles import tally_countries

    docs = spark.createDataFrame([(1, "Seoul and south korea; the U.S. and us, New Zealand"), (2, None), (3, ""), (4, "Mexico City, mexico and Mexican pesos; JAPANESE yen yen YEN; EU eu; a won b"), (None, "İ Seoul\u0130 seoul")], "doc_id long, text string")
    names = [("KR", "South Korea", False), ("KR", "Seoul", False), ("KR", "won", False), ("US", "U.S.", True), ("US", "US", True), ("NZ", "new zealand", False), ("MX", "mexico", False), ("MX", "mexico city", False), ("MX", "Mexican", False), ("JP", "yen", False), ("JP", "japanese", False), ("EU", "EU", True), (None, "city", False), ("X", "", False)]
    gazetteer = spark.createDataFrame(names, "code string, phrase string, strict boolean")
    got = {r.doc_id: r.countries for r in tally_countries(docs, gazetteer).collect()}
    assert got == {1: ["KR", "NZ", "US"], 2: [], 3: [], 4: ["JP", "MX", "EU"], None: ["KR"]}


@pytest.mark.parametrize("most", [1 << 16, 6])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, most):
    """With a small bound the phrases are dealt in parts that take turns."""
    import random
    import re
    from collections import Counter

    from tidemark.operators import phrases

    monkeypatch.setattr(phrases, "MOST", most)
    rng = random.Random(4)
    own = list({(f"c{rng.randint(0, 5)}", "".join(rng.choice("abA .&é") for _ in range(rng.randint(1, 6))).strip() or "a", rng.random() < 0.3) for _ in range(40)})
    texts = ["".join(rng.choice("abAB .&éÉ_") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(own + own[:3], "code string, phrase string, strict boolean")
    assert len(phrases.parts_of(table)) == (1 if most > 6 else -(-len(set(own)) * 2 // 6))
    for r in phrases.count_phrases(docs, table).collect():
        wanted = Counter()
        for code, phrase, strict in set(own):
            n = len(re.findall(rf"(?<!\w){re.escape(phrase)}(?!\w)", texts[r.doc_id], 0 if strict else re.I))
            wanted += Counter({code: n})
        assert Counter(r.hits) == wanted, texts[r.doc_id]


def test_gates_of_text(spark):
    from tidemark.functions import text, words
    from tidemark.operators import enrich

    own = [(1, "the market debut of X"), (2, "her debut"), (3, "Debut; prospectus filed"), (4, "wife's boyfriend"), (5, "IBM"), (6, None), (7, "warfare"), (8, "natural gas")]
    found = {r.i: r for r in spark.createDataFrame(own, "i int, t string").select("i", text.speaks_of_listing(F.col("t")).alias("listing"), text.wants_comments(F.col("t")).alias("comments"), text.should_classify(F.col("t")).alias("classify")).collect()}
    assert [i for i, r in found.items() if r.listing] == [1, 3]
    assert [i for i, r in found.items() if r.comments] == [4, 5, 8]
    assert [i for i, r in found.items() if r.classify] == [4, 8]
    for some in (words.FINANCIAL + words.SOCIAL, words.LISTING_STRONG, words.EVENT):
        kept = {r.t for r in spark.createDataFrame([(w,) for w in some] + [(w[:-1] + "#",) for w in some], "t string").where(text.has_keyword(F.col("t"), some)).collect()}
        assert set(some) <= kept and not any(w.endswith("#") and not any(x in w for x in some) for w in kept)
    posts = spark.createDataFrame([(1, "x", [("a", "bullish"), (None, "b"), ("c", "")]), (2, "x", []), (3, "x", None)], "i int, t string, c array<struct<author:string,body:string>>")
    assert [(r.g, r.l) for r in posts.orderBy("i").select(text.should_classify(F.col("t"), F.col("c")).alias("g"), text.comment_lines(F.col("c")).alias("l")).collect()] == [(True, "- a: bullish\n- [unknown]: b"), (False, "(No comments)"), (False, "(No comments)")]
    codes = spark.createDataFrame([(["us", " Kr ", "USA", "", None],)], "c array<string>")
    assert codes.select(text.country_codes(F.col("c")).alias("c")).first().c == ["US", "KR"]
    turns = spark.createDataFrame([(1, "bull", "growth", 1), (1, "bear", "risk", 2), (2, "bull", "risk", 1), (2, "bear", "growth", 2), (3, "bull", "growth", 1), (4, "bull", "risk", 1), (4, "bull", "growth", 3), (4, "bear", "growth", 2), (5, "user", "x", 1)], "d int, s string, t string, n int")
    assert {r.d: r.consensus for r in enrich.has_consensus(turns, ["d"], "s", "t", "n").collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_a_key_is_new_again_after_its_time(spark, tmp_path):
    """Events in files of their own, a day apart: the stream has let go of the first keys."""
    from tidemark.streaming import windows

    t = datetime(2024, 1, 1)
    schema = "user_id long, event_type string, ts timestamp"
    parts = [[(1, "a", t), (1, "a", t + timedelta(hours=1)), (2, "a", t)], [(9, "b", t + timedelta(days=1))], [(8, "b", t + timedelta(days=1))], [(1, "a", t + timedelta(days=1, hours=1))]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = windows.drain(windows.first_in_ttl(stream, ["user_id", "event_type"])).groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in found} == {1: 2, 2: 1, 8: 1, 9: 1}
    settled = windows.drain(windows.tumbling(stream.withColumn("value", F.lit(1.0)), "6 hours")).collect()
    assert [r.n for r in settled] == [3]  # the second day's windows are still open
