"""What a reader sees: sectors' news, tagged news, hot tickers as they are kept, texts of filings and lessons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.topk import top_per_group
from tidemark.operators.upsert import keep_first
from tidemark.plans.articles import not_noise
from tidemark.plans.base import EVENTS_AS_OF, at, query, view
from tidemark.plans.trends import BEARISH, BULLISH, between, exact_mean


def sector_news_snapshot(articles: DataFrame, as_of: datetime, hours: float = 24 * 7, top: int = 5) -> DataFrame:
    """Each sector's scored news within some hours: counts, mean sentiment and importance (none counts as 0), and the
    tickers that are named most. An article counts in each of its sectors, and there with each of its tickers."""
    fresh = between(articles, "published_at", as_of, hours).where(F.col("sentiment_score").isNotNull() & not_noise(F.col("event_type")) & F.col("sectors").isNotNull())
    rows = fresh.select(F.explode("sectors").alias("sector"), "sentiment_score", F.coalesce("importance_score", F.lit(0.0)).alias("importance"), "tickers")
    s = F.col("sentiment_score")
    sums = rows.groupBy("sector").agg(
        F.count("*").alias("article_count"), exact_mean(s).alias("avg_sentiment"), F.count_if(s > BULLISH).alias("bullish_count"), F.count_if(s < BEARISH).alias("bearish_count"),
        F.count_if((s <= BULLISH) & (s >= BEARISH)).alias("neutral_count"), exact_mean(F.col("importance")).alias("avg_importance"),
    )
    named = rows.select("sector", F.explode("tickers").alias("ticker")).groupBy("sector", "ticker").agg(F.count("*").alias("count"))
    best = top_per_group(named, ["sector"], [F.desc("count"), F.col("ticker")], top)
    listed = best.groupBy("sector").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker", "count"))), lambda x: F.struct(x["ticker"].alias("ticker"), x["count"].alias("count"))).alias("top_tickers"))
    return sums.join(listed, "sector", "left")


_TAGGED_SQL = "tagged as (select *, [source_name, 'all'] as sectors, case when id % 4 <> 0 then ['T' || id % 20, 'T' || id % 7] else [] end as tickers from articles_v)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda n: F.concat(F.lit("T"), (F.col("id") % n).cast("string"))
    tickers = F.when(F.col("id") % 4 != 0, F.array(name(20), name(7))).otherwise(F.array().cast("array<string>"))
    return view(spark, sf_dir, "articles_v").withColumns({"sectors": F.array("source_name", F.lit("all")), "tickers": tickers})


@query(
    "sector_news_snapshot",
    f"""with {_TAGGED_SQL}, fresh as (select * from tagged where published_at >= timestamp '2024-01-18' and published_at <= timestamp '2024-01-25' and sentiment_score is not null and (event_type is null or event_type <> 'noise')),
    rows as (select unnest(sectors) as sector, sentiment_score as s, coalesce(importance_score, 0) as i, tickers from fresh),
    best as (select sector, string_agg(ticker || ':' || n, ',' order by n desc, ticker) as top_tickers from (select sector, ticker, count(*) as n, row_number() over (partition by sector order by count(*) desc, ticker) as r from (select sector, unnest(tickers) as ticker from rows) group by 1, 2) where r <= 5 group by 1)
    select sector, count(*) as article_count, round(cast(sum(cast(round(s * 1e9) as bigint)) as double) / count(s) / 1e9, 6) as avg_sentiment, count(*) filter (where s > 0.15) as bullish_count, count(*) filter (where s < -0.15) as bearish_count,
    count(*) filter (where s between -0.15 and 0.15) as neutral_count, round(cast(sum(cast(round(i * 1e9) as bigint)) as double) / count(i) / 1e9, 6) as avg_importance, any_value(top_tickers) as top_tickers from rows left join best using (sector) group by sector""",
    "articles_v",
)
def sector_news_snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = sector_news_snapshot(_tagged(spark, sf_dir), EVENTS_AS_OF)
    return nested.withColumn("top_tickers", F.array_join(F.transform("top_tickers", lambda x: F.concat(x["ticker"], F.lit(":"), x["count"].cast("string"))), ","))


def recent_tagged(articles: DataFrame, as_of: datetime, hours: float = 72, top: int = 40) -> DataFrame:
    """The newest articles with countries, and how many there are in all."""
    tagged = between(articles, "published_at", as_of, hours).where(not_noise(F.col("event_type")) & (F.size("countries") > 0))
    newest = tagged.orderBy(F.desc("published_at"), "id").limit(top).withColumn("all of them", F.lit(1))
    total = tagged.agg(F.count("*").alias("total_tagged")).withColumn("all of them", F.lit(1))  # one row
    return newest.join(F.broadcast(total), "all of them").drop("all of them")


@query(
    "recent_tagged",
    """with tagged as (select id, headline, source_name, published_at, country from articles_v where published_at >= timestamp '2024-01-22' and published_at <= timestamp '2024-01-25' and (event_type is null or event_type <> 'noise') and country is not null and id % 5 <> 0)
    select id, source_name, published_at, upper(country) as countries, (select count(*) from tagged) as total_tagged from tagged order by published_at desc, id limit 40""",
    "articles_v",
)
def recent_tagged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array(F.upper("country")), lambda c: c.isNotNull()))
    found = recent_tagged(view(spark, sf_dir, "articles_v").withColumn("countries", tags), EVENTS_AS_OF)
    return found.select("id", "source_name", "published_at", F.array_join("countries", ",").alias("countries"), "total_tagged")


def _hot(mentions: DataFrame, until: Column, least: int = 3) -> DataFrame:
    counted = mentions.where((F.col("mentioned_at") > until - F.expr("interval 6 hours")) & (F.col("mentioned_at") <= until)).groupBy("ticker").agg(F.count("*").alias("mention_count"), exact_mean(F.col("sentiment_score")).alias("avg_sentiment"))
    return counted.where(F.col("mention_count") >= least).select("*", until.alias("first_detected_at"), until.alias("last_detected_at"))


@query(
    "hot_tickers_kept",
    """with hot as (select t, ticker, count(*) as mention_count, round(cast(sum(cast(round(sentiment_score * 1e9) as bigint)) as double) / count(sentiment_score) / 1e9, 6) as avg_sentiment
      from mentions_v, (values (timestamp '2024-01-20'), (timestamp '2024-01-22'), (timestamp '2024-01-25')) v(t) where mentioned_at > t - interval 6 hour and mentioned_at <= t group by 1, 2 having count(*) >= 3)
    select ticker, arg_max(mention_count, t) as mention_count, arg_max(avg_sentiment, t) as avg_sentiment, min(t) as first_detected_at, max(t) as last_detected_at from hot group by 1""",
    "mentions_v",
)
def hot_tickers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot tickers found at three times: each is kept as it was found last, with the time when it was found first."""
    mentions = view(spark, sf_dir, "mentions_v")
    kept = None
    for day in (20, 22, 25):
        found = _hot(mentions, at(datetime(2024, 1, day)))
        kept = found if kept is None else keep_first(kept, found, ["ticker"], ["first_detected_at"])
    return kept


@query(
    "insider_texts",
    """select ticker, string_agg(strftime(transaction_date, '%Y-%m-%d') || '  ' || case when transaction_code = 'P' then 'BUY' else 'SELL' end || '  ' || insider_name || '  $' || format('{:,}', cast(floor(abs(value_usd)) as bigint)), chr(10) order by r desc) as lines,
    any_value(head) as head from (select i.*, row_number() over (partition by i.ticker order by filed_at desc, line_key desc) as r, head from insider_v i join (
      select ticker, 'Buys: ' || count(*) filter (where transaction_code = 'P') || ' by ' || count(distinct insider_name) filter (where transaction_code = 'P') || '; sells: ' || count(*) filter (where transaction_code <> 'P') || ' by ' || count(distinct insider_name) filter (where transaction_code <> 'P') as head
      from insider_v where is_discretionary = 1 group by 1) h on h.ticker = i.ticker where is_discretionary = 1) where r <= 5 group by ticker""",
    "insider_v",
)
def insider_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's insiders in words: counts, and the five newest trades, oldest first."""
    trades = view(spark, sf_dir, "insider_v").where("is_discretionary = 1")
    bought = F.col("transaction_code") == "P"
    who = lambda c: F.count_distinct(F.when(c, F.col("insider_name"))).cast("string")
    told = trades.groupBy("ticker").agg(F.concat(F.lit("Buys: "), F.count_if(bought).cast("string"), F.lit(" by "), who(bought), F.lit("; sells: "), F.count_if(~bought).cast("string"), F.lit(" by "), who(~bought)).alias("head"))
    line = F.concat(F.date_format("transaction_date", "yyyy-MM-dd"), F.lit("  "), F.when(bought, "BUY").otherwise("SELL"), F.lit("  "), F.col("insider_name"), F.lit("  $"), F.format_number(F.floor(F.abs("value_usd")), 0))
    newest = top_per_group(trades.withColumn("line", line), ["ticker"], [F.desc("filed_at"), F.desc("line_key")], 5)
    lines = newest.groupBy("ticker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line")), asc=False), lambda x: x["line"]), "\n").alias("lines"))
    return told.join(lines, "ticker").select("ticker", "lines", "head")


@query(
    "lesson_texts",
    """with l as (select id, ticker, model_type as sector, case id % 3 when 0 then 'ticker' when 1 then 'sector' else 'market' end as scope, is_correct = 1 as ok, 'lesson ' || id as said, created_at from predictions_v where is_correct is not null),
    picked as (select ticker as who, 1 as rank, 'Ticker-Specific Lessons:' as title, '- ' || case when ok then '[SUCCESS]' else '[FAILURE]' end || ' ' || said as line, row_number() over (partition by ticker order by created_at desc, id desc) as r from l where scope = 'ticker'
      union all select w.who, 3, 'Market-Wide Lessons:', '- ' || case when ok then '[SUCCESS]' else '[FAILURE]' end || ' [Market] ' || said, r from (select *, row_number() over (order by created_at desc, id desc) as r from l where scope = 'market') l, (select distinct ticker as who from predictions_v) w where r <= 3)
    select who as ticker, string_agg(block, chr(10) || chr(10) order by rank) as lessons from (select who, rank, any_value(title) || chr(10) || string_agg(line, chr(10) order by r) as block from picked where r <= 3 group by 1, 2) group by 1""",
    "predictions_v",
)
def lesson_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past lessons as a prompt has them: each ticker's own three newest, then the three newest of the whole market."""
    told = view(spark, sf_dir, "predictions_v").where("is_correct is not null")
    scope = F.when(F.col("id") % 3 == 0, "ticker").when(F.col("id") % 3 == 1, "sector").otherwise("market")
    mark = F.when(F.col("is_correct") == 1, "[SUCCESS]").otherwise("[FAILURE]")
    lessons = told.select("id", "ticker", scope.alias("scope"), "created_at", mark.alias("mark"), F.concat(F.lit("lesson "), F.col("id")).alias("said"))
    newest = [F.desc("created_at"), F.desc("id")]
    own = top_per_group(lessons.where("scope = 'ticker'"), ["ticker"], newest, 3).select("ticker", F.lit(1).alias("place"), "rank", F.concat(F.lit("- "), "mark", F.lit(" "), "said").alias("line"))
    market = lessons.where("scope = 'market'").orderBy(*newest).limit(3).withColumn("all", F.lit(1))
    market = top_per_group(market, ["all"], newest, 3).select("all", "rank", F.concat(F.lit("- "), "mark", F.lit(" [Market] "), "said").alias("line"))  # three rows
    tickers = view(spark, sf_dir, "predictions_v").select("ticker").distinct()
    rows = own.unionByName(tickers.withColumn("all", F.lit(1)).join(F.broadcast(market), "all").select("ticker", F.lit(3).alias("place"), "rank", "line"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    title = F.when(F.col("place") == 1, "Ticker-Specific Lessons:\n").otherwise("Market-Wide Lessons:\n")
    blocks = rows.groupBy("ticker", "place").agg(block.alias("lines")).select("ticker", "place", F.concat(title, "lines").alias("block"))
    return blocks.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n").alias("lessons"))


