"""Trending tickers, sector sentiment and rotation, hot tickers, briefing."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.topk import nth_per_group, top_per_group
from tidemark.plans.base import EVENTS_AS_OF, at, query, r6, view

WATCHLIST = ("T0", "T1", "T2")
BULLISH, BEARISH = 0.15, -0.15


def between(df: DataFrame, column: str, as_of: datetime, hours: float) -> DataFrame:
    """Rows of the last hours up to as_of."""
    return df.where((F.col(column) >= at(as_of - timedelta(hours=hours))) & (F.col(column) <= at(as_of)))


def trending(mentions: DataFrame, as_of: datetime, hours: float = 24, top: int = 10) -> DataFrame:
    """Tickers by number of mentions; a missing sentiment counts as 0."""
    score = F.avg(F.coalesce("sentiment_score", F.lit(0.0)))
    counted = between(mentions, "mentioned_at", as_of, hours).groupBy("ticker").agg(F.count("*").alias("mention_count"), r6(score).alias("avg_sentiment"))
    return counted.orderBy(F.desc("mention_count"), "ticker").limit(top)


@query(
    "trending_tickers",
    """select ticker, count(*) as mention_count, round(avg(coalesce(sentiment_score, 0)), 6) as avg_sentiment from mentions_v
    where mentioned_at >= timestamp '2024-01-24' and mentioned_at <= timestamp '2024-01-25' group by ticker order by mention_count desc, ticker limit 10""",
    "mentions_v",
)
def trending_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending(view(spark, sf_dir, "mentions_v"), EVENTS_AS_OF)


def sector_mentions(mentions: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row for each sector of each mention; a sector that is listed twice counts twice."""
    return mentions.join(sectors, "ticker")


def exact_mean(column: Column) -> Column:
    """A mean to six places that doesn't depend on the order of adding: of whole billionths."""
    return r6(F.sum(F.round(column * 1e9).cast("long")).cast("double") / F.count(column) / 1e9)


def sector_snapshot(rows: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Counts and means of a sector's mentions; importance stands for urgency, 1 to 4."""
    s = F.coalesce("sentiment_score", F.lit(0.0))
    return (
        between(rows, "mentioned_at", as_of, hours)
        .groupBy("sector")
        .agg(
            F.count("*").alias("article_count"),
            exact_mean(s).alias("avg_sentiment"),
            F.count_if(s > BULLISH).alias("bullish_count"),
            F.count_if(s < BEARISH).alias("bearish_count"),
            F.count_if((s <= BULLISH) & (s >= BEARISH)).alias("neutral_count"),
        )
    )


@query(
    "sector_snapshot",
    """select sector, count(*) as article_count, round(cast(sum(cast(round(sentiment_score * 1e9) as bigint)) as double) / count(sentiment_score) / 1e9, 6) as avg_sentiment, count(*) filter (where sentiment_score > 0.15) as bullish_count,
    count(*) filter (where sentiment_score < -0.15) as bearish_count, count(*) filter (where sentiment_score between -0.15 and 0.15) as neutral_count
    from mentions_v join sector_v using (ticker) where mentioned_at >= timestamp '2024-01-24' and mentioned_at <= timestamp '2024-01-25' group by sector""",
    "mentions_v", "sector_v",
)
def sector_snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sector_snapshot(sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v")), EVENTS_AS_OF)


def sector_top_tickers(rows: DataFrame, top: int = 5) -> DataFrame:
    """Each sector's tickers with most mentions, as an array of (ticker, count)."""
    counted = rows.groupBy("sector", "ticker").agg(F.count("*").alias("count"))
    best = top_per_group(counted, ["sector"], [F.desc("count"), F.col("ticker")], top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker", "count"))), lambda x: F.struct(x["ticker"].alias("ticker"), x["count"].alias("count")))
    return best.groupBy("sector").agg(listed.alias("top_tickers"))


@query(
    "sector_top_tickers",
    """select sector, string_agg(ticker || ':' || n, ',' order by n desc, ticker) as top_tickers from (
    select sector, ticker, count(*) as n, row_number() over (partition by sector order by count(*) desc, ticker) as r from mentions_v join sector_v using (ticker) group by sector, ticker)
    where r <= 5 group by sector""",
    "mentions_v", "sector_v",
)
def sector_top_tickers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = sector_top_tickers(sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v")))
    return nested.select("sector", F.array_join(F.transform("top_tickers", lambda x: F.concat(x["ticker"], F.lit(":"), x["count"].cast("string"))), ",").alias("top_tickers"))


@query("top_sectors", "select sector, count(*) as article_count from mentions_v join sector_v using (ticker) group by sector order by article_count desc, sector limit 3", "mentions_v", "sector_v")
def top_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v"))
    return rows.groupBy("sector").agg(F.count("*").alias("article_count")).orderBy(F.desc("article_count"), "sector").limit(3)


def hot_tickers(mentions: DataFrame, sectors: DataFrame, watchlist: DataFrame, as_of: datetime, hours: float = 6, least: int = 3, top: int = 20, max_sectors: int = 3) -> DataFrame:
    """Much-mentioned tickers off the watchlist, with some of their sectors."""
    counted = between(mentions, "mentioned_at", as_of, hours).groupBy("ticker").agg(F.count("*").alias("mention_count"), r6(F.avg("sentiment_score")).alias("avg_sentiment")).where(F.col("mention_count") >= least)
    fresh = counted.join(F.broadcast(watchlist), "ticker", "left_anti").orderBy(F.desc("mention_count"), "ticker").limit(top)
    named = sectors.groupBy("ticker").agg(F.slice(F.array_sort(F.collect_set("sector")), 1, max_sectors).alias("sectors"))
    return fresh.join(named, "ticker", "left")


def watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in WATCHLIST], "ticker string")


@query(
    "hot_tickers",
    """select m.ticker, count(*) as mention_count, round(avg(sentiment_score), 6) as avg_sentiment, min(s.sector) as sectors from mentions_v m left join sector_v s using (ticker)
    where mentioned_at >= timestamp '2024-01-24 18:00:00' and mentioned_at <= timestamp '2024-01-25' and ticker not in ('T0', 'T1', 'T2') group by m.ticker having count(*) >= 3 order by mention_count desc, m.ticker limit 20""",
    "mentions_v", "sector_v",
)
def hot_tickers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hot_tickers(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v"), watchlist(spark), EVENTS_AS_OF)
    return found.withColumn("sectors", F.array_join("sectors", ","))


def rotation_signals(rows: DataFrame, as_of: datetime, volume: float = 1.5, shift: float = 0.05) -> DataFrame:
    """Sectors whose last 6 hours stand out against the hours from -48 to -6: by volume per
    hour, or by the mean sentiment's move."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("mentioned_at").cast("timestamp"))) / F.lit(3_600_000_000.0)
    recent, before = (age >= 0) & (age < 6), (age >= 6) & (age < 48)
    s = F.col("sentiment_score")
    sums = (
        between(rows, "mentioned_at", as_of, 48)
        .groupBy("sector")
        .agg(F.count_if(recent).alias("recent_count"), F.count_if(before).alias("before_count"), F.avg(F.when(recent, s)).alias("a"), F.avg(F.when(before, s)).alias("b"))
    )
    ratio = F.try_divide(F.col("recent_count") / 6.0, F.col("before_count") / 42.0)
    out = sums.select("sector", "recent_count", "before_count", r6(ratio).alias("volume_ratio"), r6(F.col("a") - F.col("b")).alias("momentum"))
    return out.withColumn("signal", F.coalesce((F.col("volume_ratio") >= volume) | (F.abs("momentum") >= shift), F.lit(False)))


@query(
    "rotation_signals",
    """select *, coalesce(volume_ratio >= 1.5 or abs(momentum) >= 0.05, false) as signal from (select sector, count(*) filter (where r) as recent_count, count(*) filter (where not r) as before_count,
    round((count(*) filter (where r) / 6.0::double) / nullif(count(*) filter (where not r) / 42.0::double, 0), 6) as volume_ratio,
    round(avg(sentiment_score) filter (where r) - avg(sentiment_score) filter (where not r), 6) as momentum
    from (select *, mentioned_at > timestamp '2024-01-24 18:00:00' as r from mentions_v join sector_v using (ticker)) where mentioned_at > timestamp '2024-01-23' and mentioned_at <= timestamp '2024-01-25' group by sector)""",
    "mentions_v", "sector_v",
)
def rotation_signals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_signals(sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v")), EVENTS_AS_OF)


def bucket_snapshots(rows: DataFrame, minutes: int = 15) -> DataFrame:
    """Mean sentiment of each sector's mentions in each quarter of an hour that has some."""
    start = F.window(F.col("mentioned_at").cast("timestamp"), f"{minutes} minutes")["start"].cast("timestamp_ntz")
    return rows.groupBy("sector", start.alias("snapshot_time")).agg(F.avg("sentiment_score").alias("avg_sentiment"))


def momentum(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot's mean less the fourth-newest's; 0 without one."""
    newest_first = [F.desc("snapshot_time")]
    now = nth_per_group(snapshots, ["sector"], newest_first, 1)
    then = nth_per_group(snapshots, ["sector"], newest_first, 4).select("sector", F.col("avg_sentiment").alias("then"))
    moved = F.col("avg_sentiment") - F.col("then")
    return now.join(then, "sector", "left").select("sector", "snapshot_time", r6(F.coalesce(moved, F.lit(0.0))).alias("momentum"))


@query(
    "momentum_4th_newest",
    """select a.sector, a.snapshot_time, round(coalesce(a.avg_sentiment - b.avg_sentiment, 0.0::double), 6) as momentum from s a left join s b on a.sector = b.sector and b.r = 4 where a.r = 1""".replace(
        "select a.sector",
        "with s as (select sector, time_bucket(interval '15 minutes', mentioned_at) as snapshot_time, avg(sentiment_score) as avg_sentiment, row_number() over (partition by sector order by time_bucket(interval '15 minutes', mentioned_at) desc) as r from mentions_v join sector_v using (ticker) group by 1, 2) select a.sector",
        1,
    ),
    "mentions_v", "sector_v",
)
def momentum_4th_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum(bucket_snapshots(sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v"))))


def briefing(articles: DataFrame, as_of: datetime, hours: float = 24 * 30, top: int = 30, sector: str = "source_name") -> DataFrame:
    """The most important articles that are no noise, then grouped by their primary sector."""
    fresh = between(articles, "published_at", as_of, hours).where(~F.col("event_type").eqNullSafe("noise"))
    best = fresh.orderBy(F.desc_nulls_last("importance_score"), F.desc("published_at"), "id").limit(top)
    ids = F.array_sort(F.collect_list(F.struct((-F.coalesce("importance_score", F.lit(-1.0))).alias("o"), "id")))
    grouped = best.groupBy(F.coalesce(F.col(sector), F.lit("General")).alias("sector")).agg(F.count("*").alias("articles"), ids.alias("ids"))
    return grouped.withColumn("ids", F.transform("ids", lambda x: x["id"]))


@query(
    "briefing_by_sector",
    """select coalesce(source_name, 'General') as sector, count(*) as articles, string_agg(id::varchar, ',' order by -coalesce(importance_score, -1), id) as ids from (
    select * from articles_v where published_at >= timestamp '2023-12-26' and published_at <= timestamp '2024-01-25' and (event_type is null or event_type <> 'noise')
    order by importance_score desc nulls last, published_at desc, id limit 30) group by 1""",
    "articles_v",
)
def briefing_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing(view(spark, sf_dir, "articles_v"), EVENTS_AS_OF).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("watchlist_semi", "select ticker, count(*) as n from mentions_v where ticker in ('T0', 'T1', 'T2') group by ticker", "mentions_v")
def watchlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mentions_v").join(F.broadcast(watchlist(spark)), "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"))


@query("watchlist_anti", "select ticker, count(*) as n from mentions_v where ticker not in ('T0', 'T1', 'T2') group by ticker", "mentions_v")
def watchlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mentions_v").join(F.broadcast(watchlist(spark)), "ticker", "left_anti").groupBy("ticker").agg(F.count("*").alias("n"))


@query(
    "sector_daily_snapshot",
    """select sector, cast(mentioned_at as date) as day, count(*) as mention_count, round(avg(sentiment_score), 10) as avg_sentiment,
    round(count(*) filter (where sentiment_score > 0.15) / count(*)::double, 6) as bullish_ratio from mentions_v join sector_v using (ticker) group by 1, 2""",
    "mentions_v", "sector_v",
)
def sector_daily_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v"))
    s = F.col("sentiment_score")
    return rows.groupBy("sector", F.to_date("mentioned_at").alias("day")).agg(F.count("*").alias("mention_count"), F.round(F.avg(s), 10).alias("avg_sentiment"), r6(F.count_if(s > BULLISH) / F.count("*")).alias("bullish_ratio"))


@query(
    "ticker_share_of_sector",
    "select sector, ticker, count(*) as n, round(count(*) / (sum(count(*)) over (partition by sector))::double, 6) as share from mentions_v join sector_v using (ticker) group by sector, ticker",
    "mentions_v", "sector_v",
)
def ticker_share_of_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sector_mentions(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "sector_v")).groupBy("sector", "ticker").agg(F.count("*").alias("n"))
    return counted.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("sector"))))
