"""News feeds and JSON news services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.dates import parse_timestamp
from tidemark.sources.base import article, head, source

_RSS = "channel struct<title:string,item:array<struct<title:string,link:string,description:string,pubDate:string>>>"
_ATOM = "title string, entry array<struct<title:string,link:struct<_href:string>,content:string,updated:string>>"
_RFC822 = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z")


def _rfc822(column):
    # the name of the day is not needed, and may be wrong
    return parse_timestamp(F.regexp_replace(column, r"^[A-Za-z]{3},\s*", ""), "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX")


@source("rss")
def rss(landed: DataFrame, max_items: int = 30) -> DataFrame:
    feed = landed.withColumn("feed", F.from_xml("payload", _RSS)).where("feed.channel.item is not null")
    items = feed.select("fetched_at", F.col("feed.channel.title").alias("name"), F.posexplode("feed.channel.item").alias("n", "item")).where("item.link is not null and item.title is not null and n < %d" % max_items)
    return items.select(*article(F.col("item.title"), F.col("item.description"), F.col("name"), "rss", F.col("item.link"), _rfc822(F.col("item.pubDate"))))


@source("reddit")
def reddit(landed: DataFrame, max_items: int = 25) -> DataFrame:
    feed = landed.withColumn("feed", F.from_xml("payload", _ATOM)).where("feed.entry is not null")
    items = feed.select("fetched_at", F.col("feed.title").alias("name"), F.posexplode("feed.entry").alias("n", "item")).where("item.title is not null and n < %d" % max_items)
    when = parse_timestamp(F.col("item.updated"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return items.select(*article(F.col("item.title"), F.col("item.content"), F.concat(F.lit("reddit/"), F.col("name")), "social", F.col("item.link._href"), when))


@source("hackernews")
def hackernews(landed: DataFrame, most: int = 30) -> DataFrame:
    """Items as JSON objects; those with financial words, the first by score."""
    items = landed.withColumn("item", F.from_json("payload", "id bigint, title string, url string, time bigint, score bigint, type string")).where("item.title is not null")
    items = items.where(text.has_keyword(F.col("item.title"), bounded=False)).withColumn("feed", F.lit(1))
    url = F.coalesce("item.url", F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("item.id").cast("string")))
    best = head(items, ["feed"], [F.desc("item.score"), F.col("item.id")], most)
    return best.select(*article(F.col("item.title"), F.lit(""), F.lit("Hacker News"), "social", url, F.timestamp_seconds("item.time")))


@source("finnhub")
def finnhub(landed: DataFrame, most: int = 20) -> DataFrame:
    rows = landed.select("fetched_at", F.posexplode(F.from_json("payload", "array<struct<headline:string,summary:string,source:string,url:string,datetime:bigint>>")).alias("n", "x")).where("x.url is not null and x.headline is not null")
    both = F.concat_ws(" ", "x.headline", "x.summary")
    kept = rows.where(text.has_financial_content(both)).withColumn("feed", F.lit(1))
    best = head(kept, ["feed"], [F.desc("x.datetime"), F.col("x.url")], most)
    return best.select(*article(F.col("x.headline"), F.col("x.summary"), F.coalesce("x.source", F.lit("Finnhub")), "api", F.col("x.url"), F.timestamp_seconds("x.datetime"), text.tickers_in(F.col("x.headline"))))


@source("alpha_vantage")
def alpha_vantage(landed: DataFrame, most: int = 20, max_tickers: int = 10) -> DataFrame:
    schema = "feed array<struct<title:string,url:string,summary:string,source:string,time_published:string,ticker_sentiment:array<struct<ticker:string,ticker_sentiment_score:string>>>>"
    rows = landed.select("fetched_at", F.explode(F.from_json("payload", schema)["feed"]).alias("x"))
    names = F.filter(F.transform("x.ticker_sentiment", lambda t: t["ticker"]), lambda t: ~t.startswith("CRYPTO:"))
    tickered = rows.withColumn("tickers", F.slice(names, 1, max_tickers)).where("size(tickers) > 0").withColumn("feed", F.lit(1))
    best = head(tickered, ["feed"], [F.desc("x.time_published"), F.col("x.url")], most)
    return best.select(*article(F.col("x.title"), F.col("x.summary"), F.coalesce("x.source", F.lit("Alpha Vantage")), "api", F.col("x.url"), parse_timestamp(F.col("x.time_published"), "yyyyMMdd'T'HHmmss"), F.col("tickers")))


@source("nitter")
def nitter(landed: DataFrame, least: int = 10) -> DataFrame:
    """Posts of a rendered timeline: link, time and text of each, as regular parts of the page."""
    posts = landed.select("fetched_at", F.explode(F.regexp_extract_all("payload", F.lit(r'(?s)<div class="timeline-item.*?<div class="tweet-content[^>]*>.*?</div>'), F.lit(0))).alias("post"))
    link = F.regexp_extract("post", r'<a class="tweet-link" href="([^"#]+)', 1)
    when = F.regexp_extract("post", r'<span class="tweet-date"><a [^>]*title="([^"]+)"', 1)
    body = text.strip_html(F.regexp_extract("post", r'(?s)<div class="tweet-content[^>]*>(.*?)</div>', 1))
    rows = posts.select("fetched_at", link.alias("link"), when.alias("when"), body.alias("body")).where((F.length("body") >= least) & (F.col("link") != ""))
    headline = F.concat(F.substring("body", 1, 120), F.when(F.length("body") > 120, "...").otherwise(""))
    published = F.coalesce(*(F.try_to_timestamp("when", F.lit(f)) for f in ("MMM d, yyyy · h:mm a 'UTC'", "d MMM yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")))
    return rows.select(*article(headline, F.col("body"), F.lit("nitter"), "social", F.concat(F.lit("https://nitter.net"), F.col("link")), published))
