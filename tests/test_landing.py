"""The data source of landed feeds: mirrors, failures, offsets."""

from __future__ import annotations

import functools
import json
import threading
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.sources import base, feeds, landing


def put(root, source, item, payload):
    folder = root / source
    folder.mkdir(parents=True, exist_ok=True)
    (folder / item).write_text(payload)


RSS = '<rss><channel><title>Wire</title><item><title>{0}</title><link>https://a.example/{0}</link><description>x</description></item></channel></rss>'


def news(i):
    return json.dumps([{"headline": f"AAPL earnings {i}", "summary": "s", "source": "X", "url": f"https://b.example/{i}", "datetime": 1706000000}])


def test_the_first_mirror_that_answers_is_taken(spark, tmp_path):
    first, second, third = (tmp_path / x for x in ("first", "second", "third"))
    put(first, "wire", "1.xml", "")  # empty: no answer
    put(first, "wire", "2.xml", RSS.format("two"))
    put(first, "wire", "3.xml", "<html>blocked</html>")  # not what is accepted
    put(first, "wire", "_SUCCESS", "no item")
    for root in (second, third):
        for k, word in enumerate(("one", "two", "three"), 1):
            put(root, "wire", f"{k}.xml", RSS.format(word))
    put(third, "wire", "4.xml", "<rss broken")
    got = {r.item: r for r in landing.read_feeds(spark, [f"{tmp_path}/gone", str(first), str(second), str(third)], ["wire", "silent"], accept="<rss").collect()}
    assert {k: r.mirror for k, r in got.items()} == {"1.xml": str(second), "2.xml": str(first), "3.xml": str(second), "4.xml": str(third), None: None}
    assert got[None].source == "silent" and got[None].payload is None and got[None].error
    rows = landing.read_feeds(spark, [str(first)], ["wire"], accept="<rss").collect()
    failed = [r for r in rows if r.payload is None]
    assert len(rows) == 3 and len(failed) == 2 and all("payload" in r.error for r in failed)


def test_http_mirrors(spark, tmp_path):
    put(tmp_path / "site", "timeline", "bob", "<div class=timeline-item>post</div>")
    server = ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(SimpleHTTPRequestHandler, directory=str(tmp_path / "site")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        there = f"http://127.0.0.1:{server.server_port}"
        got = {r.item: r for r in landing.read_feeds(spark, ["http://127.0.0.1:9", there], ["timeline"], items="bob,eve", accept="timeline-item", timeout="3").collect()}
    finally:
        server.shutdown()
    assert got["bob"].mirror == there and got["bob"].payload.startswith("<div") and got["bob"].error is None
    assert got["eve"].payload is None and "404" in got["eve"].error


def test_each_source_goes_through_its_parser(spark, tmp_path):
    put(tmp_path, "rss", "1.xml", RSS.format("one"))
    put(tmp_path, "rss", "2.xml", "<broken")
    put(tmp_path, "finnhub", "1.json", news(1))
    put(tmp_path, "finnhub", "2.json", "[broken")
    landed = landing.read_feeds(spark, [str(tmp_path)], ["rss", "finnhub", "reddit"])
    assert landed.rdd.getNumPartitions() == 3
    parsers = {name: base.SOURCES[name] for name in ("rss", "finnhub", "reddit")}
    assert parsers["rss"] is feeds.rss
    got = base.fan_in(landing.articles(landed, parsers)).collect()
    assert sorted((r.source_type, r.url) for r in got) == [("api", "https://b.example/1"), ("rss", "https://a.example/one")]


def test_a_stream_reads_what_has_arrived(spark, tmp_path):
    root, out = tmp_path / "in", f"{tmp_path}/out"

    def drain():
        stream = landing.stream_feeds(spark, [f"{tmp_path}/gone", str(root)], ["a", "b"])
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source, r.item) for r in spark.read.schema(landing.SCHEMA).parquet(out).collect())

    put(root, "a", "001", "x")
    put(root, "b", "005", "x")
    assert drain() == [("a", "001"), ("b", "005")]
    assert drain() == [("a", "001"), ("b", "005")]
    put(root, "a", "002", "x")
    put(root, "a", "003", "")
    got = drain()
    assert got == [("a", "001"), ("a", "002"), ("a", "003"), ("b", "005")]


def test_what_a_feed_needs():
    with pytest.raises(ValueError, match="mirrors"):
        landing.Mirrors({"sources": "a"})
