"""Views over articles: news lists, backlogs, statistics, countries, text gates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, market, text, words
from tidemark.operators.phrases import count_phrases, top_codes
from tidemark.operators.topk import top_per_group
from tidemark.plans.base import EVENTS_AS_OF, query, r6, table, view
from tidemark.plans.trends import between

NEWEST_FIRST = (F.desc_nulls_last, F.desc)


def not_noise(event_type: Column) -> Column:
    """True unless it is noise; unclassified counts as not noise."""
    return ~event_type.eqNullSafe("noise")


def by_importance() -> list[Column]:
    return [F.desc_nulls_last("importance_score"), F.desc("published_at"), F.col("id")]


def general_news(articles: DataFrame, as_of: datetime, kinds: tuple[str, ...] = ("general",), least: float = 3.0, hours: float = 24 * 14, top: int = 50) -> DataFrame:
    fresh = between(articles, "published_at", as_of, hours)
    return fresh.where(F.lower("event_type").isin(*kinds) & (F.col("importance_score") >= least)).orderBy(*by_importance()).limit(top)


@query(
    "general_news",
    """select id, headline, importance_score, published_at from articles_v where published_at >= timestamp '2024-01-11' and published_at <= timestamp '2024-01-25' and lower(event_type) in ('general')
    and importance_score >= 3 order by importance_score desc nulls last, published_at desc, id limit 50""",
    "articles_v",
)
def general_news_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return general_news(view(spark, sf_dir, "articles_v"), EVENTS_AS_OF).select("id", "headline", "importance_score", "published_at")


@query("recent_canonical", "select id, source_name, published_at from articles_v where published_at <= timestamp '2024-01-25' and id % 7 <> 3 order by published_at desc, id limit 100", "articles_v")
def recent_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = view(spark, sf_dir, "articles_v").withColumn("duplicate_of", F.when(F.col("id") % 7 == 3, F.col("id") - 1))
    fresh = articles.where(F.col("duplicate_of").isNull() & (F.col("published_at") <= F.lit(EVENTS_AS_OF).cast("timestamp_ntz")))
    return fresh.orderBy(F.desc("published_at"), "id").limit(100).select("id", "source_name", "published_at")


def ticker_news(mentions: DataFrame, articles: DataFrame, ticker: str | None = None, per_ticker: int = 5) -> DataFrame:
    """Each ticker's best articles; the mention's own sentiment goes before the article's."""
    own = mentions if ticker is None else mentions.where(F.col("ticker") == ticker)
    named = articles.select(F.col("id").alias("article_id"), "headline", F.col("sentiment_score").alias("article_sentiment"), "importance_score", "event_type")
    joined = own.join(named, "article_id").where(not_noise(F.col("event_type")))
    best = top_per_group(joined, ["ticker"], [F.desc_nulls_last("importance_score"), F.desc("mentioned_at"), F.col("article_id")], per_ticker)
    return best.select("ticker", "rank", "article_id", "headline", r6(F.coalesce("sentiment_score", "article_sentiment")).alias("sentiment"), "importance_score")


@query(
    "ticker_news",
    """select ticker, r as rank, article_id, headline, round(s, 6) as sentiment, importance_score from (select m.ticker, m.article_id, a.headline, coalesce(m.sentiment_score, a.sentiment_score) as s, a.importance_score,
    row_number() over (partition by m.ticker order by a.importance_score desc nulls last, m.mentioned_at desc, m.article_id) as r from mentions_v m join articles_v a on a.id = m.article_id
    where a.event_type is null or a.event_type <> 'noise') where r <= 5""",
    "mentions_v", "articles_v",
)
def ticker_news_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticker_news(view(spark, sf_dir, "mentions_v"), view(spark, sf_dir, "articles_v"))


@query(
    "latest_summaries_per_ticker",
    """select ticker, article_id, headline from (select m.ticker, m.article_id, a.headline, row_number() over (partition by m.ticker order by a.published_at desc, m.article_id) as r
    from mentions_v m join articles_v a on a.id = m.article_id) where r = 1""",
    "mentions_v", "articles_v",
)
def latest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "articles_v").select(F.col("id").alias("article_id"), "headline", "published_at")
    joined = view(spark, sf_dir, "mentions_v").join(named, "article_id")
    return top_per_group(joined, ["ticker"], [F.desc("published_at"), F.col("article_id")], 1).select("ticker", "article_id", "headline")


def _backlog(name: str, where: str, condition) -> None:
    @query(name, f"select id, published_at from articles_v where {where} order by published_at, id limit 50", "articles_v")
    def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, "articles_v").where(condition()).orderBy("published_at", "id").limit(50).select("id", "published_at")


_backlog("backlog_unclassified", "event_type is null", lambda: F.col("event_type").isNull())
# every seventh's rank and every ninth's country are still to come here
_backlog("backlog_unranked", "event_type is not null and event_type <> 'noise' and (importance_score is null or id % 7 = 0)", lambda: F.col("event_type").isNotNull() & (F.col("event_type") != "noise") & (F.col("importance_score").isNull() | (F.col("id") % 7 == 0)))
_backlog("backlog_geo", "country is null or id % 9 = 0", lambda: F.col("country").isNull() | (F.col("id") % 9 == 0))
# the number of attempts so far stands in id % 5 here; some were never tried
_backlog("backlog_unembedded", "coalesce(nullif(id % 5, 4), 0) < 3 and event_type is null", lambda: (F.coalesce(F.nullif(F.col("id") % 5, F.lit(4)), F.lit(0)) < 3) & F.col("event_type").isNull())


@query(
    "news_geo_counts",
    "select upper(country) as country, count(*) as n, round(coalesce(avg(sentiment_score), 0), 6) as avg_sentiment, coalesce(max(case when importance_score > 0 then importance_score end), 0) as max_importance from articles_v where event_type is null or event_type <> 'noise' group by 1",
    "articles_v",
)
def news_geo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by country: the mean skips unscored ones, the maximum skips 0."""
    articles = view(spark, sf_dir, "articles_v").where(not_noise(F.col("event_type")))
    exploded = articles.withColumn("country", F.explode(F.array(F.upper("country"))))
    importance = F.max(F.when(F.col("importance_score") > 0, F.col("importance_score")))
    return exploded.groupBy("country").agg(F.count("*").alias("n"), r6(F.coalesce(F.avg("sentiment_score"), F.lit(0.0))).alias("avg_sentiment"), F.coalesce(importance, F.lit(0.0)).alias("max_importance"))


@query("dedup_stats", "select count(*) as total, count(*) filter (where id % 7 = 3) as duplicates, count(*) filter (where id % 2 = 0) as checked from articles_v", "articles_v")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "articles_v").agg(F.count("*").alias("total"), F.count_if(F.col("id") % 7 == 3).alias("duplicates"), F.count_if(F.col("id") % 2 == 0).alias("checked"))


@query("system_stats", "select source_name, count(*) as articles, max(published_at) as last_published, count(event_type) as classified, count(importance_score) as ranked from articles_v group by source_name", "articles_v")
def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "articles_v").groupBy("source_name").agg(F.count("*").alias("articles"), F.max("published_at").alias("last_published"), F.count("event_type").alias("classified"), F.count("importance_score").alias("ranked"))


@query(
    "sentiment_distribution",
    "select count(*) filter (where sentiment_score > 0.15) as bullish, count(*) filter (where sentiment_score < -0.15) as bearish, count(*) filter (where sentiment_score between -0.15 and 0.15) as neutral, round(100.0::double * count(sentiment_score) / nullif(count(*), 0), 6) as coverage from articles_v",
    "articles_v",
)
def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentiment_score")
    return view(spark, sf_dir, "articles_v").agg(F.count_if(s > 0.15).alias("bullish"), F.count_if(s < -0.15).alias("bearish"), F.count_if(s.between(-0.15, 0.15)).alias("neutral"), r6(F.try_divide(F.lit(100.0) * F.count(s), F.count("*"))).alias("coverage"))


_ANY_KEYWORD = "(?:" + "|".join(words.FINANCIAL) + ")"
_ANY_WORD = "(?:" + "|".join(w.replace("'", "''") for w in words.FINANCIAL + words.SOCIAL) + ")"
_KEYWORD_SQL = rf"(^|\W){_ANY_KEYWORD}(\W|$)"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in words.NO_TICKERS) + "]"
_TICKERS_SQL = rf"len(list_filter(regexp_split_to_array({{0}}, '\W+'), lambda x: regexp_full_match(x, '[A-Z]{{{{2,5}}}}') and not list_contains({_STOP_SQL}, x))) > 0"
_CAPITALS_SQL = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("prefilter_strict", f"select doc_id, contains(text, '$') or {_TICKERS_SQL.format('text')} or regexp_matches(lower(text), '{_KEYWORD_SQL}') as financial from documents")
def prefilter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_financial_content(F.col("text")).alias("financial"))


@query("prefilter_substring", f"select doc_id, contains(text, '$') or {_TICKERS_SQL.format(_CAPITALS_SQL)} or regexp_matches(lower(text), '{_ANY_KEYWORD}') as financial from documents")
def prefilter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_financial_content(F.col("text"), compat=True).alias("financial"))


@query("event_gate", "select doc_id, " + " or ".join(f"contains(lower(text), '{w}')" for w in words.EVENT) + " as event from documents")
def event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.speaks_of_event(F.col("text")).alias("event"))


_WORD_SQL = rf"(^|\W){_ANY_WORD}(\W|$)"


@query("wants_comments", rf"select doc_id, regexp_matches(text, '(^|\W)[A-Z]{{2,5}}(\W|$)') or regexp_matches(lower(text), '{_WORD_SQL}') as wanted from documents")
def wants_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.wants_comments(F.col("text")).alias("wanted"))


@query(
    "classify_with_comments",
    rf"""with told as (select conv_id, string_agg(text, ' ' order by turn) as comments, string_agg('- ' || role || ': ' || text, chr(10) order by turn) as lines from conversations where text <> '' group by 1)
    select p.page_id, regexp_matches(t, '\$[A-Z]{{1,5}}(\W|$)') or regexp_matches(lower(t), '{_WORD_SQL}') as classify, coalesce(lines, '(No comments)') as lines from (select page_id, coalesce(url || ' ' || comments, url) as t, lines from pages left join told on conv_id = page_id) p""",
)
def classify_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts (pages' addresses) with the turns of a conversation as their comments."""
    comment = F.struct(F.col("role").alias("author"), F.col("text").alias("body"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", comment.alias("c")))), lambda x: x["c"]).alias("comments"))
    posts = table(spark, sf_dir, "pages").join(turns, F.col("conv_id") == F.col("page_id"), "left")
    return posts.select("page_id", text.should_classify(F.col("url"), F.col("comments")).alias("classify"), text.comment_lines(F.col("comments")).alias("lines"))


@query("should_classify", rf"select doc_id, regexp_matches(text, '\$[A-Z]{{1,5}}(\W|$)') or regexp_matches(lower(text), '{_WORD_SQL}') as classify from documents")
def should_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.should_classify(F.col("text")).alias("classify"))


def tally_countries(docs: DataFrame, gazetteer: DataFrame, top: int = 3, text_col: str = "text") -> DataFrame:
    """docs with countries in place of the text: the codes whose names are in it most often, at most top, ties by code.

    gazetteer: code, phrase and strict (whether its case counts); each name is counted by itself."""
    found = top_codes(count_phrases(docs, gazetteer, text_col), top)
    return found.withColumnRenamed("codes", "countries").drop(text_col)


#: Documents that speak of nations, and the names by which these are known: the fifth ones in capitals only.
_NATIONS_SQL = """spoken as (select d.doc_id, d.text || ' ' || lower(a.n_name) || ', ' || b.n_name || ' and ' || b.n_name || ' or x' || a.n_name as text
    from documents d join nation a on a.n_nationkey = d.doc_id % 25 join nation b on b.n_nationkey = (d.doc_id * 7) % 23),
  names as (select printf('N%02d', n_nationkey) as code, n_name as name, n_nationkey % 5 = 0 as strict from nation union all select printf('N%02d', n_nationkey), split_part(n_name, ' ', 1), false from nation where contains(n_name, ' '))"""


@query(
    "extract_countries",
    f"""with {_NATIONS_SQL}, hits as (select doc_id, code, sum(len(case when strict then regexp_extract_all(text, '\\b' || name || '\\b') else regexp_extract_all(lower(text), '\\b' || lower(name) || '\\b') end)) as n from spoken, names group by 1, 2)
    select s.doc_id, coalesce(string_agg(code, ',' order by n desc, code), '') as countries from spoken s left join (select *, row_number() over (partition by doc_id order by n desc, code) as r from hits where n > 0) h on h.doc_id = s.doc_id and r <= 3 group by s.doc_id""",
)
def extract_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations that documents speak of; each text has two more, one of them in small letters, by rule."""
    nation = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code")
    names = nation.select(code, F.col("n_name").alias("phrase"), (F.col("n_nationkey") % 5 == 0).alias("strict"))
    first = nation.where(F.contains("n_name", F.lit(" "))).select(code, F.split_part("n_name", F.lit(" "), F.lit(1)).alias("phrase"), F.lit(False).alias("strict"))
    a, b = (nation.select(F.col("n_nationkey").alias(f"key {k}"), F.col("n_name").alias(k)) for k in "ab")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spoken = docs.join(a, F.col("key a") == F.col("doc_id") % 25).join(b, F.col("key b") == F.col("doc_id") * 7 % 23)
    text_ = F.concat("text", F.lit(" "), F.lower("a"), F.lit(", "), "b", F.lit(" and "), "b", F.lit(" or x"), "a")
    found = tally_countries(spoken.select("doc_id", text_.alias("text")), names.unionByName(first))
    return found.withColumn("countries", F.array_join("countries", ","))


@query(
    "html_strip",
    r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) as text from pages""",
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("url_domain", r"select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as domain from pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("content_hash_dedup", "select min(doc_id) as doc_id, count(*) as copies, sha256(text) as content_hash from documents group by text")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts meet by their hash; map-side counts keep a text with very many copies cheap."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.lit(None).cast("string"), F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "normalize_company",
    """select s_name || case s_suppkey % 4 when 0 then ', Inc.' when 1 then ' Holdings PLC' when 2 then ' Co., Ltd.' else '' end as name,
    replace(lower(s_name), '#', '') || case s_suppkey % 4 when 1 then ' holdings' when 2 then ' co' else '' end as normalized from supplier
    union all select c_name, replace(lower(c_name), '#', '') from customer""",
)
def normalize_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    suffix = F.when(k == 0, ", Inc.").when(k == 1, " Holdings PLC").when(k == 2, " Co., Ltd.").otherwise("")
    names = table(spark, sf_dir, "supplier").select(F.concat("s_name", suffix).alias("name")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))
    return names.select("name", text.normalize_company(F.col("name")).alias("normalized"))


@query(
    "normalize_date",
    """select o_orderkey, case o_orderkey % 8 when 1 then date_trunc('quarter', d) when 6 then null when 3 then case when strftime(d, '%m%d') < '0125' then make_date(2025, month(d), day(d)) else make_date(2024, month(d), day(d)) end else d end::date as day
    from (select *, o_orderdate::date as d from orders)""",
)
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates in eight spellings and back."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 8
    spelled = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 1, F.concat(F.lit("in q"), F.quarter(d), F.lit(" "), F.year(d)))
        .when(k == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 3, F.date_format(d, "MMM. d"))
        .when(k == 4, F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMM yyyy")))
        .when(k == 5, F.date_format(d, "M/d/yyyy"))
        .when(k == 6, F.lit("TBD"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    told = table(spark, sf_dir, "orders").select("o_orderkey", spelled.alias("raw"))
    return told.select("o_orderkey", dates.normalize_date(F.col("raw"), date(2024, 1, 25)).alias("day"))


@query("classify_market", "select c_custkey, case c_custkey % 7 when 0 then 'KR' when 1 then 'KR' when 2 then 'CRYPTO' when 3 then 'US' when 4 then 'OTHER' when 5 then 'US' else 'OTHER' end as market from customer")
def classify_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of seven kinds made of customers' keys and segments."""
    key, k, name = F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.col("c_custkey") % 7, F.col("c_mktsegment")
    symbol = (
        F.when(k == 0, key).when(k == 1, F.concat(key, F.lit(".kq"))).when(k == 2, F.concat(F.substring(name, 1, 3), F.lit("-USD")))
        .when(k == 3, F.substring(name, 1, 5)).when(k == 4, F.concat(name, F.lit("LONG"))).when(k == 5, F.concat(F.lower(F.substring(name, 1, 3)), F.lit(".b"))).otherwise(F.concat(F.substring(key, 3, 4), F.lit(".T")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", market.classify_market(symbol).alias("market"))


@query(
    "low_signal_shortcut",
    "select id, case when urgency = 'low' and abs(sentiment_score) < 0.1 then 1.0::double else importance_score end as importance_score from (select *, case id % 4 when 0 then 'low' else 'high' end as urgency from articles_v)",
    "articles_v",
)
def low_signal_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = view(spark, sf_dir, "articles_v").withColumn("urgency", F.when(F.col("id") % 4 == 0, "low").otherwise("high"))
    dull = (F.col("urgency") == "low") & (F.abs("sentiment_score") < 0.1)
    return articles.select("id", F.when(dull, 1.0).otherwise(F.col("importance_score")).alias("importance_score"))


@query(
    "critical_alerts",
    "select id, importance_score from articles_v where importance_score >= 9 and id % 3 = 0 and id % 6 <> 0",
    "articles_v",
)
def critical_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and very important, and not alerted before."""
    articles = view(spark, sf_dir, "articles_v").withColumn("urgency", F.when(F.col("id") % 3 == 0, "critical").otherwise("low"))
    sent = articles.where(F.col("id") % 6 == 0).select("id")
    urgent = articles.where(F.col("urgency").isin("high", "critical") & (F.col("importance_score") >= 9))
    return urgent.join(sent, "id", "left_anti").select("id", "importance_score")


def _any_of(some: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains(lower(text), '{w}')" for w in some) + ")"


@query("ipo_gate", f"select doc_id, {_any_of(words.LISTING_STRONG)} or ({_any_of(words.LISTING_WEAK)} and {_any_of(words.LISTING_CONTEXT)}) as gate from (select doc_id, text || case doc_id % 4 when 0 then ' debut' when 1 then ' Listed on' when 2 then ' IPO' else '' end || case when doc_id % 3 = 0 then ' Underwriter' else '' end as text from documents)")
def ipo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strong word, or a weak one with context; texts have some of each by rule."""
    k = F.col("doc_id") % 4
    more = F.when(k == 0, " debut").when(k == 1, " Listed on").when(k == 2, " IPO").otherwise("")
    whole = F.concat("text", more, F.when(F.col("doc_id") % 3 == 0, " Underwriter").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.speaks_of_listing(whole).alias("gate"))
