from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.sources import base, feeds, filings

NOW = datetime(2024, 1, 25)


def landed(spark, *payloads):
    return spark.createDataFrame([(p, NOW) for p in payloads], "payload string, fetched_at timestamp")


RSS = """<rss><channel><title>Wire</title>
<item><title> Shares rise </title><link>https://a.example/1</link><description>&lt;p&gt;Up &amp;amp; away&lt;/p&gt;</description><pubDate>Tue, 23 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>No date</title><link>https://a.example/2</link><description>x</description></item>
<item><title>No link</title></item></channel></rss>"""


def test_rss(spark):
    rows = {r.url: r for r in feeds.rss(landed(spark, RSS, "<broken", "")).collect()}
    assert set(rows) == {"https://a.example/1", "https://a.example/2"}
    first = rows["https://a.example/1"]
    assert (first.headline, first.summary, first.source_name, first.published_at) == ("Shares rise", "Up & away", "Wire", datetime(2024, 1, 23, 10))
    assert rows["https://a.example/2"].published_at == NOW
    assert len(first.id) == 12


def test_json_services(spark):
    news = json.dumps([{"headline": "AAPL earnings beat", "summary": "s", "source": "X", "url": "https://b.example/1", "datetime": 1706000000}, {"headline": "nice weather", "summary": "sun", "url": "https://b.example/2", "datetime": 1}])
    rows = feeds.finnhub(landed(spark, news, "[broken")).collect()
    assert [(r.url, r.affected_tickers) for r in rows] == [("https://b.example/1", ["AAPL"])]
    vantage = json.dumps({"feed": [{"title": "t", "url": "u1", "summary": "s", "source": "z", "time_published": "20240123T101500", "ticker_sentiment": [{"ticker": "CRYPTO:BTC"}, {"ticker": "IBM"}]}, {"title": "t", "url": "u2", "time_published": "x", "ticker_sentiment": [{"ticker": "CRYPTO:BTC"}]}]})
    found = feeds.alpha_vantage(landed(spark, vantage)).collect()
    assert [(r.url, r.affected_tickers, r.published_at) for r in found] == [("u1", ["IBM"], datetime(2024, 1, 23, 10, 15))]
    items = [json.dumps({"id": i, "title": f"stock story {i}", "time": 1706000000, "score": i}) for i in range(40)]
    assert feeds.hackernews(landed(spark, *items)).count() == 30


def test_timeline(spark):
    page = '<div class="timeline-item "><a class="tweet-link" href="/a/status/1#m"></a><span class="tweet-date"><a href="x" title="Jan 23, 2024 · 9:30 AM UTC">t</a></span><div class="tweet-content media-body" dir="auto">' + "long text " * 20 + "</div></div>"
    short = '<div class="timeline-item "><a class="tweet-link" href="/a/status/2"></a><div class="tweet-content">hi</div></div>'
    rows = feeds.nitter(landed(spark, page + short)).collect()
    assert len(rows) == 1
    assert rows[0].headline.endswith("...") and len(rows[0].headline) == 123
    assert rows[0].published_at == datetime(2024, 1, 23, 9, 30)


def test_fan_in_keeps_one_row_for_a_url(spark):
    parsed = feeds.rss(landed(spark, RSS))
    assert base.fan_in([parsed, parsed]).count() == 2
    assert set(base.SOURCES) >= {"rss", "reddit", "hackernews", "finnhub", "alpha_vantage", "nitter"}


def test_price_bars(spark):
    chart = json.dumps({"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [1706000000, 1706090000], "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1.5, None], "volume": [10, 20]}]}}]}})
    rows = filings.price_bars(landed(spark, chart)).collect()
    assert [(r.ticker, r.date, r.close, r.volume) for r in rows] == [("A", date(2024, 1, 23), 1.5, 10)]


def test_filing_index_and_map(spark):
    index = json.dumps({"cik": "320193", "filings": {"recent": {"accessionNumber": ["1-24-1", "2-24-2", "3-24-3"], "form": ["4", "4/A", "10-K"], "filingDate": ["2024-01-02", "2024-01-03", "2024-01-04"], "primaryDocument": ["a", "b", "c"]}}})
    rows = {r.accession_no: r for r in filings.filing_index(landed(spark, index), ("4",)).collect()}
    assert set(rows) == {"1-24-1", "2-24-2"}
    assert rows["2-24-2"].is_amendment and rows["1-24-1"].cik == "0000320193"
    assert rows["1-24-1"].filed_at == datetime(2024, 1, 2, 23, 59, 59)
    assert filings.filing_index(landed(spark, index), ("4",), since="2024-01-03").count() == 1
    names = filings.cik_map(landed(spark, json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"}})))
    assert [tuple(r) for r in names.collect()] == [("AAPL", "0000320193", "Apple")]


FORM4 = """<ownershipDocument><issuer><issuerCik>320193</issuerCik><issuerTradingSymbol>aapl</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable>
<nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>M</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></nonDerivativeTransaction>
</nonDerivativeTable></ownershipDocument>"""


def test_form4(spark):
    doc = landed(spark, FORM4).withColumn("accession_no", F.lit("x-1")).withColumn("filed_at", F.lit(NOW))
    rows = {r.id: r for r in filings.form4(doc).collect()}
    assert set(rows) == {"x-1_0", "x-1_1"}
    sale = rows["x-1_0"]
    assert (sale.ticker, sale.value_usd, sale.is_discretionary, sale.is_director, sale.is_10b5_1) == ("AAPL", -25.0, True, True, None)
    assert rows["x-1_1"].value_usd is None and rows["x-1_1"].is_discretionary is False


def test_flow_table(spark):
    row = "<tr><td>2024.01.02</td><td>70,000</td><td>1.5%</td><td>1,000</td><td>-50</td><td>+20</td><td>500</td></tr>"
    page = row + row + "<tr><td>2024.01.03</td><td>1</td></tr>"
    rows = filings.kr_flows(landed(spark, page).withColumn("ticker", F.lit("005930"))).collect()
    assert [(r.trade_date, r.inst_net, r.foreign_net) for r in rows] == [(date(2024, 1, 2), -50.0, 20.0)]


def test_calendars(spark):
    earnings = json.dumps({"earningsCalendar": [{"symbol": "a", "date": "2024-02-01", "quarter": 1, "year": 2024, "hour": "amc"}, {"symbol": "b", "date": ""}]})
    rows = filings.earnings_calendar(landed(spark, earnings)).collect()
    assert [(r.ticker, r.event_date, r.event_title, r.notes) for r in rows] == [("A", date(2024, 2, 1), "a Q1 FY2024 earnings", "after close")]
    ipos = json.dumps({"ipoCalendar": [{"name": "N", "price": "14.00-16.00", "date": "2024-02-01", "status": "priced"}, {"name": "F", "status": "filed"}]})
    assert [(r.company_name, r.offering_price, r.status) for r in filings.ipo_calendar(landed(spark, ipos)).collect()] == [("N", "14.00-16.00", "priced")]
