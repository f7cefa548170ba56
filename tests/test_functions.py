from __future__ import annotations

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, market, text, vector


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("t", "strict", "compat"),
    [("AAPL beats estimates", True, True), ("the best day", False, True), ("THE GPU", False, False), ("costs $5", True, True), ("quarterly earnings rise", True, True), ("stockpile of wood", False, True), ("", False, False), (None, False, False)],
)
def test_financial_content(spark, t, strict, compat):
    rows = spark.createDataFrame([(t,)], "t string")
    got = rows.select(text.has_financial_content(F.col("t")).alias("s"), text.has_financial_content(F.col("t"), compat=True).alias("c")).first()
    assert (got.s, got.c) == (strict, compat)


def test_calendar_windows(spark):
    from datetime import date

    import pytest

    first, last = dates.month_bounds(F.lit("2024-02-11").cast("date"))
    assert (one(spark, first), one(spark, last)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert dates.checked_window(date(2024, 1, 1), date(2025, 2, 4)) == (date(2024, 1, 1), date(2025, 2, 4))
    for window in ((date(2024, 1, 2), date(2024, 1, 1)), (date(2024, 1, 1), date(2025, 2, 5))):
        with pytest.raises(ValueError):
            dates.checked_window(*window)


def test_what_models_answer(spark):
    from tidemark.operators import enrich, upsert

    notes = spark.createDataFrame([([(" aapl ", "a"), ("AAPL", "b"), (None, "x"), ("  ", "y"), ("ibm", None)],), (None,)], "n array<struct<ticker:string,summary:string>>")
    assert [r.m for r in notes.select(text.notes_map(F.col("n")).alias("m")).collect()] == [{"AAPL": "b", "IBM": ""}, {}]
    calls = spark.createDataFrame([((None, None), (5, 6), (7, 8)), ((1, None), (5, 6), None), ((None, 2), None, (7, 8)), ((None, None), (5, None), (7, 8)), (None, None, None)], "e struct<prompt:int,candidate:int>, m struct<prompt:int,candidate:int>, u struct<prompt:int,candidate:int>")
    used = calls.select(enrich.token_usage(F.col("e"), F.col("m"), F.col("u")).alias("t")).collect()
    assert [tuple(r.t) for r in used] == [(5, 6), (1, 6), (7, 2), (5, 0), (0, 0)]
    failures = spark.createDataFrame([(429, None), (None, "Read TIMED OUT"), (400, "bad json"), (None, None), (503, "x")], "s int, m string")
    assert [r.t for r in failures.select(enrich.is_transient(F.col("s"), F.col("m")).alias("t")).collect()] == [True, True, False, False, True]
    rows = enrich.mark_noise(spark.createDataFrame([(1, "general"), (2, None)], "i int, event_type string"), F.col("i") == 2).orderBy("i").collect()
    assert [(r.event_type, r.urgency, r.sentiment_score) for r in rows] == [("general", None, None), ("noise", "low", 0.0)] and rows[1].classification_summary == enrich.NOISE_SUMMARY
    posts = spark.createDataFrame([("social", "reddit/stocks"), ("social", "x"), ("rss", "reddit/x"), (None, None)], "k string, n string")
    assert [r.p for r in posts.select(text.is_forum_post(F.col("k"), F.col("n")).alias("p")).collect()] == [True, False, False, False]
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "t string, n int, first int")
    new = spark.createDataFrame([("b", 9, 5), ("c", 3, 5)], "t string, n int, first int")
    assert sorted(map(tuple, upsert.keep_first(old, new, ["t"], ["first"]).collect())) == [("a", 1, 1), ("b", 9, 1), ("c", 3, 5)]


def test_text_helpers(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &amp; b<script>x</p></script><!-- c --></p>"))) == "a & b"
    assert one(spark, text.strip_code_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.normalize_company(F.lit("Acme Holdings Inc."))) == "acme holdings"
    for name, wanted in (("Reddit, Inc.", "reddit"), ("Reddit", "reddit"), ("삼성전자", "삼성전자"), ("Group 1 Automotive", "group 1 automotive"), ("Blackstone L.P.", "blackstone"), ("A & B  Co", "a b"), ("Nestlé Group Limited", "nestlé"), ("Nestlé Limited Group", "nestlé limited")):
        assert one(spark, text.normalize_company(F.lit(name))) == wanted, name
    assert one(spark, text.content_hash(F.lit("ab"), F.lit("c"))) == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, text.speaks_of_event(F.lit("They UNVEILED it"))) is True
    assert one(spark, text.domain(F.lit("https://WWW.Example.com/a?b"))) == "example.com"
    assert one(spark, text.truncate_words(F.lit("one two three"), 8)) == "one two"
    assert one(spark, text.truncate_words(F.lit("onetwothree"), 5)) == "onetw"
    assert one(spark, text.embedding_text(F.lit("h"), F.lit(""))) == "h"
    assert one(spark, text.split_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, text.json_list(F.lit('["a"'))) == []
    assert one(spark, text.is_greeting(F.lit("Hello there!"))) is True
    assert one(spark, text.token_estimate(F.lit("abcdefghi"))) == 2


def test_dates(spark):
    assert one(spark, dates.normalize_date(F.lit("Q2 2026"), date(2026, 1, 1))) == date(2026, 4, 1)
    assert one(spark, dates.normalize_date(F.lit("March 3"), date(2026, 5, 1))) == date(2027, 3, 3)
    assert one(spark, dates.normalize_date(F.lit("soon"), date(2026, 5, 1))) is None
    for raw in ("January 15th, 2026", "January 15,2026", "Jan 15th 2026", "15 January 2026", "1/15/2026", "January 15", "tomorrow", "in 1 day"):
        assert one(spark, dates.normalize_date(F.lit(raw), date(2026, 1, 14))) == date(2026, 1, 15), raw
    assert one(spark, dates.normalize_date(F.lit("Q4-2026"), date(2026, 1, 1))) == date(2026, 10, 1)
    assert one(spark, dates.next_trading_day(F.lit(date(2026, 6, 26)))) == date(2026, 6, 29)
    assert one(spark, dates.end_of_day(F.lit(date(2026, 6, 26)))) == datetime(2026, 6, 26, 23, 59, 59)


def test_market(spark):
    assert one(spark, market.krx_code(F.lit("5930.KS"))) == "005930"
    assert one(spark, market.signed_log(F.lit(None).cast("double"))) == 0
    assert one(spark, market.signed_log(F.lit(-1e12))) == -1
    assert one(spark, market.llm_cost(F.lit("unheard of"), F.lit(1_000_000), F.lit(0))) == 2.0


def test_cosine(spark):
    vec = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(spark, vector.cosine(vec(1.0, 2.0), vec(2.0, 4.0))) == pytest.approx(1, abs=1e-12)
    assert one(spark, vector.cosine(vec(1.0, 0.0), vec(0.0, 1.0))) == pytest.approx(0, abs=1e-12)
    assert one(spark, vector.cosine(vec(0.0, 0.0), vec(0.0, 1.0))) is None
