"""Sources read landed payloads: a fetcher outside the engine puts raw answers into a folder, and
a source turns (payload, fetched_at) rows into typed ones.  A bad payload gives no rows, never an
error; sources are joined by unionByName, so they run side by side as partitions of one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text

Parser = Callable[[DataFrame], DataFrame]
SOURCES: dict[str, Parser] = {}

ARTICLE_COLUMNS = ("id", "headline", "summary", "source_name", "source_type", "url", "published_at", "affected_tickers")


def source(name: str) -> Callable[[Parser], Parser]:
    def keep(parser: Parser) -> Parser:
        SOURCES[name] = parser
        return parser

    return keep


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a landing folder as payloads, with the time they were put there."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.decode("content", "UTF-8").alias("payload"), F.col("modificationTime").alias("fetched_at"))


def article(headline: Column, summary: Column, name: Column, kind: str, url: Column, published: Column, tickers: Column | None = None) -> list[Column]:
    """The columns of an article as sources give them; an unreadable time is the time of fetching."""
    return [
        text.short_id(url).alias("id"),
        F.trim(headline).alias("headline"),
        F.substring(text.strip_html(F.coalesce(summary, F.lit(""))), 1, 2000).alias("summary"),
        name.alias("source_name"),
        F.lit(kind).alias("source_type"),
        url.alias("url"),
        F.coalesce(published, F.col("fetched_at")).alias("published_at"),
        (F.coalesce(tickers, F.array().cast("array<string>")) if tickers is not None else F.array().cast("array<string>")).alias("affected_tickers"),
    ]


def head(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each feed, as its own limit."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def fan_in(parsed: list[DataFrame]) -> DataFrame:
    """All sources' articles, one row for each url: the first published wins."""
    rows = reduce(DataFrame.unionByName, parsed)
    place = F.row_number().over(Window.partitionBy("url").orderBy("published_at", "source_name", "headline"))
    return rows.withColumn("place", place).where("place = 1").drop("place")
