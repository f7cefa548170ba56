"""The whole feature vector of each ticker and day, its training and its use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.market import signed_log, urgency_rank
from tidemark.operators.ewm import ewm_mean
from tidemark.operators.lineage import cut
from tidemark.plans.base import VIEWS, query, r6, table, view
from tidemark.plans.indicators import last, moves, series

CENTS = "decimal(18,2)"

#: The columns of the vector and what each is where nothing is known.
DEFAULTS = {
    "sentiment_avg_1d": 0.0, "sentiment_avg_3d": 0.0, "sentiment_avg_7d": 0.0, "sentiment_momentum": 0.0, "news_velocity": 1.0, "avg_importance": 0.0, "bullish_ratio": 0.5, "max_urgency_24h": 0.0,
    "return_1d": 0.0, "return_5d": 0.0, "sma_crossover": 0.0, "rsi_14": 50.0, "volatility": 0.0, "volume_anomaly": 1.0, "macd_hist": 0.0, "bb_width": 0.0, "atr_14": 0.0,
    "vix_level": 20.0, "vix_change_1d": 0.0, "market_return_1d": 0.0, "treasury_yield_change": 0.0,
    "sector_etf_return_1d": 0.0, "llm_historical_accuracy": 0.5,
    "insider_buy_ratio_90d": 0.5, "insider_net_value_30d_norm": 0.0, "insider_cluster_buy_30d": 0.0, "days_since_insider_buy": 180.0,
    "activist_stake_90d": 0.0, "stake_filings_180d": 0.0,
    "kr_inst_net_5d_norm": 0.0, "kr_foreign_net_5d_norm": 0.0, "kr_flow_momentum": 0.0,
}
INSIDER = [c for c in DEFAULTS if "insider" in c] + ["activist_stake_90d", "stake_filings_180d"]
FLOWS = [c for c in DEFAULTS if c.startswith("kr_")]

#: Bars that a day needs up to it for a vector.
ENOUGH = 20

_TICKER = "case cast({0} % 5 as int) when 0 then 'click' when 1 then 'view' when 2 then 'purchase' when 3 then 'error' else 'signup' end"
VIEWS |= {
    # every relation of the vector under the tickers and in the month of the bars
    "mention_b": "select event_type as ticker, (value - 250) / 250 as sentiment_score, case cast(event_id % 4 as int) when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as urgency, case when event_id % 7 <> 0 then cast(event_id % 101 as bigint) end as importance, case cast(event_id % 3 as int) when 0 then 'bullish' when 1 then 'bearish' end as direction, ts as mentioned_at from {events}",
    "insider_b": f"select concat(cast(l_orderkey as string), '_', cast(l_linenumber as string)) as line_key, {_TICKER.format('l_suppkey')} as ticker, concat('P', cast(l_partkey % 500 as string)) as insider_name, cast(l_shipdate as date) + 9496 as transaction_date, cast(cast(l_shipdate as date) + 9498 as timestamp) as filed_at, case l_returnflag when 'A' then 'P' when 'R' then 'S' else 'M' end as transaction_code, case when l_returnflag in ('A','R') then 1 else 0 end as is_discretionary, l_extendedprice as value_usd from {{lineitem}}",
    "flows_b": f"select {_TICKER.format('l_suppkey')} as ticker, cast(l_shipdate as date) + 9496 as trade_date, sum(case when l_linestatus = 'F' then l_quantity else -l_quantity end) as inst_net, sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as foreign_net, sum(l_quantity) as total_value from {{lineitem}} group by 1, 2",
    "prediction_b": f"select o_orderkey as id, {_TICKER.format('o_custkey')} as ticker, o_orderdate + interval '9496' day as created_at, case o_orderstatus when 'F' then 1 when 'O' then 0 end as is_correct from {{orders}}",
}
#: Of the test tickers: the market each is traded on, and whose bars stand for its sector's fund.
MARKETS = {"click": "US", "purchase": "US", "view": "KR", "signup": "KR"}
FUNDS = {"click": "purchase", "view": "signup"}
INDICES = {"vix": "error", "market": "view", "treasury": "click"}


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def price_columns(bars: DataFrame) -> DataFrame:
    """Nine price columns of each day by the bars up to it; days with fewer than ENOUGH have none."""
    close, before = F.col("close"), F.lag("close").over(series())
    base = F.coalesce(F.lag("close", 5).over(series()), F.first("close").over(series()))
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = moves(bars).withColumns({"i": F.row_number().over(series()), "r": ratio(close - before, before), "r5": ratio(close - base, base), "reach": reach})
    for span, name in ((12, "fast"), (26, "slow")):
        rows = ewm_mean(rows, "close", ["ticker"], ["bar_date"], span, name)
    rows = ewm_mean(rows.withColumn("line", F.col("fast") - F.col("slow")), "line", ["ticker"], ["bar_date"], 9, "signal")
    mean = F.avg("close").over(last(20))
    gain, loss = F.avg("gain").over(last(14)), F.avg("loss").over(last(14))
    out = rows.select(
        "ticker", F.col("bar_date").alias("day"), "close", "i",
        F.col("r").alias("return_1d"), F.col("r5").alias("return_5d"),
        ratio(F.avg("close").over(last(5)) - mean, mean).alias("sma_crossover"),
        F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss))).alias("rsi_14"),
        F.stddev_pop("r").over(last(20)).alias("volatility"),
        ratio(F.col("volume"), F.avg("volume").over(last(20))).alias("volume_anomaly"),
        (F.col("line") - F.col("signal")).alias("macd_hist"),
        ratio(4 * F.stddev_samp("close").over(last(20)), mean).alias("bb_width"),
        F.avg("reach").over(last(14)).alias("atr_14"),
    )
    return out.where(F.col("i") >= ENOUGH)


def regime_columns(bars: DataFrame, indices: dict[str, str]) -> DataFrame:
    """Four columns for each day on which an index has a bar and one before it; a day without
    takes the newest before.  One row for each day of the calendar goes through the window."""
    close, before = F.col("close"), F.lag("close").over(series())
    rows = bars.where(F.col("ticker").isin(*indices.values())).select("ticker", F.col("bar_date").alias("day"), "close", before.alias("before")).where("before is not null")

    def of(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("ticker") == indices[name], value))

    change = ratio(close - F.col("before"), F.col("before"))
    days = rows.groupBy("day").agg(of("vix", close).alias("vix_level"), of("vix", change).alias("vix_change_1d"), of("market", change).alias("market_return_1d"), of("treasury", close - F.col("before")).alias("treasury_yield_change"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("day", *(F.last(c, ignorenulls=True).over(so_far).alias(c) for c in days.columns if c != "day"))


def daily_facts(mentions: DataFrame, filings: DataFrame, stakes: DataFrame, flows: DataFrame, predictions: DataFrame) -> DataFrame:
    """All that is known by ticker and day, summed by day before anything is shuffled further.

    Times are those of disclosure (mentioned, filed, traded, predicted), never of the event,
    so that no row tells what nobody could know yet."""
    scored = F.col("sentiment_score").isNotNull()
    said = mentions.groupBy("ticker", F.to_date("mentioned_at").alias("day")).agg(
        F.count_if(scored).alias("m_n"), F.sum(F.round(F.col("sentiment_score") * 100000).cast("long")).alias("m_s"), F.count("importance").alias("i_n"), F.sum("importance").alias("i_s"),
        F.count_if(F.col("direction") == "bullish").alias("up_n"), F.count_if(F.col("direction").isin("bullish", "bearish")).alias("way_n"), F.max(urgency_rank(F.col("urgency")) - 1).alias("urgent"),
    )
    real = filings.where("is_discretionary = 1").withColumns({"day": F.to_date("filed_at"), "bought": F.col("transaction_code").eqNullSafe("P"), "worth": F.abs(F.coalesce(F.col("value_usd"), F.lit(0.0))).cast(CENTS)})
    newest = F.when(F.col("bought"), F.struct("filed_at", "line_key"))
    filed = real.groupBy("ticker", "day").agg(F.sum(F.when(F.col("bought"), F.col("worth"))).alias("bought"), F.sum(F.when(~F.col("bought"), F.col("worth"))).alias("sold"), F.max_by("transaction_date", newest).alias("bought_on"))
    staked = stakes.groupBy("ticker", F.to_date("filed_at").alias("day")).agg(F.count_if(F.col("is_activist")).alias("activist"), F.count("*").alias("stakes"))

    sessions = Window.partitionBy("ticker").orderBy("trade_date")
    nets = {f"{name}_{n}": F.sum(F.coalesce(F.col(f"{name}_net"), F.lit(0.0))).over(sessions.rowsBetween(1 - n, 0)) for n in (5, 20) for name in ("inst", "foreign")}
    traded = flows.withColumns(nets | {"traded": F.sum("total_value").over(sessions.rowsBetween(-19, 0)), "session": F.row_number().over(sessions)})
    flow = F.when((F.col("session") >= 5) & (F.col("traded") > 0), F.struct(*nets, "traded"))
    flowed = traded.select("ticker", F.col("trade_date").alias("day"), F.struct(flow.alias("of")).alias("flow"))

    ten = Window.partitionBy("ticker").orderBy("created_at", "id").rowsBetween(-9, 0)
    right = predictions.where("is_correct is not null").withColumn("share", F.avg("is_correct").over(ten))
    judged = right.groupBy("ticker", F.to_date("created_at").alias("day")).agg(F.max_by("share", F.struct("created_at", "id")).alias("accuracy"))

    facts = said
    for more in (filed, staked, flowed, judged):
        facts = facts.unionByName(more, allowMissingColumns=True)
    return facts


def buyers(filings: DataFrame, days: DataFrame, n: int = 30) -> DataFrame:
    """Distinct insiders who bought, by ticker and day, over the last n days: names are made
    distinct by day first, then go to the n days that see them."""
    bought = filings.where("is_discretionary = 1 and transaction_code = 'P' and insider_name <> ''").select("ticker", F.to_date("filed_at").alias("on"), "insider_name").distinct()
    seen = bought.withColumn("day", F.explode(F.sequence("on", F.date_add("on", n - 1), F.expr("interval 1 day"))))
    return seen.join(F.broadcast(days), "day", "left_semi").groupBy("ticker", "day").agg(F.count_distinct("insider_name").alias("insider_cluster_buy_30d"))


def known_by_day(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """keys (ticker, day) with sums over the days up to each and the newest of what is carried on.

    Keys and facts go through one shuffle by ticker and one sort by day; all windows share
    them.  A ticker has one row for each day and kind of fact there, whatever the raw rows."""

    def over(n: int | None) -> Window:
        by_day = Window.partitionBy("ticker").orderBy(F.unix_date("day"))
        return by_day.rangeBetween(Window.unboundedPreceding if n is None else 1 - n, 0)

    def total(c: str, n: int) -> Column:
        return F.coalesce(F.sum(c).over(over(n)), F.lit(0))

    def mean(n: int) -> Column:
        return F.coalesce(ratio(total("m_s", n) / 100000.0, total("m_n", n)), F.lit(0.0))

    both = keys.withColumn("wanted", F.lit(True)).unionByName(facts, allowMissingColumns=True)
    flow, since = F.last("flow", ignorenulls=True).over(over(None))["of"], F.datediff("day", F.last("bought_on", ignorenulls=True).over(over(None)))
    month = flow["traded"]
    bought, sold = total("bought", 90).cast("double"), total("sold", 90).cast("double")
    columns = {
        "sentiment_avg_1d": mean(1), "sentiment_avg_3d": mean(3), "sentiment_avg_7d": mean(7), "sentiment_momentum": mean(1) - mean(7),
        "news_velocity": ratio(total("m_n", 3) / 3.0, total("m_n", 14) / 14.0),
        "avg_importance": ratio(total("i_s", 7) / 10.0, total("i_n", 7)),
        "bullish_ratio": ratio(total("up_n", 7).cast("double"), total("way_n", 7)),
        "max_urgency_24h": F.greatest(F.max("urgent").over(over(7)), F.lit(0)),
        "llm_historical_accuracy": F.last("accuracy", ignorenulls=True).over(over(None)),
        "insider_buy_ratio_90d": ratio(bought, bought + sold),
        "insider_net_value_30d_norm": signed_log((total("bought", 30) - total("sold", 30)).cast("double")),
        "days_since_insider_buy": F.when(since.isNotNull(), F.least(F.greatest(since, F.lit(0)), F.lit(180))),  # greatest() skips nulls
        "activist_stake_90d": total("activist", 90), "stake_filings_180d": total("stakes", 180),
        "kr_inst_net_5d_norm": flow["inst_5"] / month, "kr_foreign_net_5d_norm": flow["foreign_5"] / month,
        "kr_flow_momentum": (flow["inst_5"] + flow["foreign_5"]) / month - (flow["inst_20"] + flow["foreign_20"]) / month / 4.0,
    }
    return both.select("ticker", "day", "wanted", *(c.alias(name) for name, c in columns.items())).where("wanted").drop("wanted")


def routed(rows: DataFrame, market: Column) -> DataFrame:
    """Insiders and stakes count on the US market, investor flows on the Korean; elsewhere neither."""
    us, kr = market.eqNullSafe("US"), market.eqNullSafe("KR")
    return rows.withColumns({c: F.when(us, F.col(c)) for c in INSIDER} | {c: F.when(kr, F.col(c)) for c in FLOWS})


def feature_vector(prices: DataFrame, known: DataFrame, cluster: DataFrame, regime: DataFrame, funds: DataFrame, market: Column) -> DataFrame:
    """One row of 32 columns for each ticker and day with enough bars; what isn't known takes
    its default.  funds: ticker and the fund whose return stands for its sector."""
    returns = prices.select(F.col("ticker").alias("fund"), "day", F.col("return_1d").alias("sector_etf_return_1d"))
    sector = funds.join(returns, "fund").select("ticker", "day", "sector_etf_return_1d")
    wide = prices.join(known, ["ticker", "day"], "left").join(cluster, ["ticker", "day"], "left").join(sector, ["ticker", "day"], "left")
    wide = wide.join(F.broadcast(regime), "day", "left")  # a row for each day of the calendar
    return routed(wide, market).select("ticker", "day", *(r6(F.coalesce(F.col(c).cast("double"), F.lit(v))).alias(c) for c, v in DEFAULTS.items()))


def looked_up(of: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), of)


def _sums(cte: str, table_: str, time: str, columns: str) -> str:
    return f"{cte} as (select k.ticker, k.day, {columns} from k join {table_} x on x.ticker = k.ticker and cast(x.{time} as date) <= k.day group by k.ticker, k.day)"


def _in(n: int, what: str, column: str) -> str:
    return f"coalesce({what} filter (where cast({column} as date) > k.day - {n}), 0)"


_W = "over (partition by ticker order by bar_date rows between {} preceding and current row)"
_W5, _W14, _W20 = _W.format(4), _W.format(13), _W.format(19)
_VECTOR_SQL = f"""with recursive b as (select *, row_number() over w as i, lag(close) over w as p, lag(close, 5) over w as l5, first_value(close) over w as f from bars_v window w as (partition by ticker order by bar_date)),
e as (select ticker, i, close as f, close as s from b where i = 1 union all select b.ticker, b.i, b.close * 2 / 13 + e.f * 11 / 13, b.close * 2 / 27 + e.s * 25 / 27 from e join b on b.ticker = e.ticker and b.i = e.i + 1),
g as (select ticker, i, f - s as macd, f - s as signal from e where i = 1 union all select e.ticker, e.i, e.f - e.s, (e.f - e.s) * 0.2::double + g.signal * 0.8::double from g join e on e.ticker = g.ticker and e.i = g.i + 1),
m as (select *, (close - p) / p as r, case when p is not null then greatest(close - p, 0) end as gain, case when p is not null then greatest(p - close, 0) end as loss, greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) as tr from b),
px as (select * from (select ticker, bar_date as day, i, r as return_1d, (close - coalesce(l5, f)) / coalesce(l5, f) as return_5d, avg(close) {_W5} / avg(close) {_W20} - 1 as sma_crossover, case when avg(loss) {_W14} = 0 then 100 else 100 - 100 / (1 + avg(gain) {_W14} / avg(loss) {_W14}) end as rsi_14,
stddev_pop(r) {_W20} as volatility, volume / avg(volume) {_W20} as volume_anomaly, 4 * stddev_samp(close) {_W20} / avg(close) {_W20} as bb_width, avg(tr) {_W14} as atr_14 from m) where i >= {ENOUGH}),
k as (select ticker, day from px),
x0 as (select day, max(case when ticker = 'error' then close end) as vix_level, max(case when ticker = 'error' then r end) as vix_change_1d, max(case when ticker = 'view' then r end) as market_return_1d, max(case when ticker = 'click' then close - p end) as treasury_yield_change from (select *, bar_date as day from m where p is not null) group by day),
x1 as (select d.day, arg_max(vix_level, x0.day) as vix_level, arg_max(vix_change_1d, x0.day) as vix_change_1d, arg_max(market_return_1d, x0.day) as market_return_1d, arg_max(treasury_yield_change, x0.day) as treasury_yield_change from (select distinct day from k) d join x0 on x0.day <= d.day group by d.day),
{_sums('s', 'mention_b', 'mentioned_at', ', '.join(f"coalesce(sum(cast(round(sentiment_score * 100000) as bigint)) filter (where cast(mentioned_at as date) > k.day - {n}) / 100000.0::double / nullif(count(*) filter (where cast(mentioned_at as date) > k.day - {n}), 0), 0) as a{n}" for n in (1, 3, 7)) + f", {_in(3, 'count(*)', 'mentioned_at')} as n3, {_in(14, 'count(*)', 'mentioned_at')} as n14, sum(importance) filter (where cast(mentioned_at as date) > k.day - 7)::double / 10 / nullif(count(importance) filter (where cast(mentioned_at as date) > k.day - 7), 0) as avg_importance, count(*) filter (where direction = 'bullish' and cast(mentioned_at as date) > k.day - 7)::double / nullif(count(direction) filter (where cast(mentioned_at as date) > k.day - 7), 0) as bullish_ratio, max(case urgency when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end) filter (where cast(mentioned_at as date) > k.day - 7) as max_urgency_24h")},
q as (select *, case when transaction_code = 'P' then cast(abs(value_usd) as decimal(18,2)) else 0 end as bought, case when transaction_code <> 'P' then cast(abs(value_usd) as decimal(18,2)) else 0 end as sold from insider_b where is_discretionary = 1),
{_sums('n', 'q', 'filed_at', f"{_in(90, 'sum(bought)', 'filed_at')}::double as b90, {_in(90, 'sum(sold)', 'filed_at')}::double as s90, {_in(30, 'sum(bought - sold)', 'filed_at')}::double as net, count(distinct case when transaction_code = 'P' and cast(filed_at as date) > k.day - 30 then insider_name end) as insider_cluster_buy_30d, date_diff('day', arg_max(transaction_date, (filed_at, line_key)) filter (where transaction_code = 'P'), k.day) as since")},
{_sums('t', "(select * from insider_b where value_usd > 50000)", 'filed_at', "count(*) filter (where transaction_code = 'P' and cast(filed_at as date) > k.day - 90) as activist_stake_90d, count(*) filter (where cast(filed_at as date) > k.day - 180) as stake_filings_180d")},
f0 as (select k.ticker, k.day, x.inst_net, x.foreign_net, x.total_value, row_number() over (partition by k.ticker, k.day order by trade_date desc) as place from k join flows_b x on x.ticker = k.ticker and x.trade_date <= k.day),
f1 as (select ticker, day, sum(inst_net) filter (where place <= 5) as i5, sum(foreign_net) filter (where place <= 5) as f5, sum(inst_net + foreign_net) as a20, sum(total_value) as v from f0 where place <= 20 group by all having count(*) >= 5),
h0 as (select k.ticker, k.day, x.is_correct, row_number() over (partition by k.ticker, k.day order by created_at desc, id desc) as place from k join prediction_b x on x.ticker = k.ticker and cast(x.created_at as date) <= k.day where is_correct is not null),
h as (select ticker, day, avg(is_correct) as llm_historical_accuracy from h0 where place <= 10 group by all),
w as (select px.*, macd - signal as macd_hist, x1.* exclude (day), a1 as sentiment_avg_1d, a3 as sentiment_avg_3d, a7 as sentiment_avg_7d, a1 - a7 as sentiment_momentum, (n3 / 3.0::double) / nullif(n14 / 14.0::double, 0) as news_velocity, avg_importance, bullish_ratio, max_urgency_24h, llm_historical_accuracy,
z.return_1d as sector_etf_return_1d, us.b90 / nullif(us.b90 + us.s90, 0) as insider_buy_ratio_90d, sign(us.net) * least(log10(abs(us.net) + 1) / 10, 1) as insider_net_value_30d_norm, us.insider_cluster_buy_30d, case when us.since is not null then least(greatest(us.since, 0), 180) end as days_since_insider_buy, t.activist_stake_90d, t.stake_filings_180d,
i5 / v as kr_inst_net_5d_norm, f5 / v as kr_foreign_net_5d_norm, (i5 + f5) / v - a20 / v / 4 as kr_flow_momentum from px join g using (ticker, i) left join x1 on x1.day = px.day left join s on s.ticker = px.ticker and s.day = px.day left join h on h.ticker = px.ticker and h.day = px.day
left join px z on z.day = px.day and z.ticker = case px.ticker when 'click' then 'purchase' when 'view' then 'signup' end left join n us on us.ticker = px.ticker and us.day = px.day and px.ticker in ('click', 'purchase')
left join t on t.ticker = px.ticker and t.day = px.day and px.ticker in ('click', 'purchase') left join f1 on f1.ticker = px.ticker and f1.day = px.day and px.ticker in ('view', 'signup'))
select ticker, day, """ + ", ".join(f"round(coalesce({c}::double, {v}::double), 6) as {c}" for c, v in DEFAULTS.items()) + " from w"  # fmt: skip


@query("feature_vector", _VECTOR_SQL, "bars_v", "mention_b", "insider_b", "flows_b", "prediction_b")
def feature_vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, filings = view(spark, sf_dir, "bars_v"), view(spark, sf_dir, "insider_b")
    prices = cut(price_columns(bars))  # a row for each ticker and day, read three times
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()  # the calendar of the bars
    stakes = filings.where("value_usd > 50000").withColumn("is_activist", F.col("transaction_code").eqNullSafe("P"))
    facts = daily_facts(view(spark, sf_dir, "mention_b"), filings, stakes, view(spark, sf_dir, "flows_b"), view(spark, sf_dir, "prediction_b"))
    known = known_by_day(prices.select("ticker", "day"), facts)
    funds = spark.createDataFrame(list(FUNDS.items()), "ticker string, fund string")
    return feature_vector(prices, known, buyers(filings, days), regime_columns(bars, INDICES), funds, looked_up(F.col("ticker"), MARKETS))


def labelled(vectors: DataFrame, bars: DataFrame, horizon: int, folds: int) -> DataFrame:
    """vectors with label (whether the close rises by the horizon), weight (fading with age, by
    the size of the move) and fold: 0 is only trained on, the folds after it are equal parts."""
    close, later = F.col("close"), F.lead("close", horizon).over(series())
    whole = Window.partitionBy("ticker")
    ahead = bars.select("ticker", F.col("bar_date").alias("day"), "close", later.alias("later"), F.row_number().over(series()).alias("i")).where(F.col("later").isNotNull() & (F.col("i") > ENOUGH))
    i, n = F.row_number().over(whole.orderBy("day")), F.count("*").over(whole)
    size = F.greatest(F.floor(n / (folds + 1)), F.lit(1))
    fold = F.greatest(F.floor((i - 1 - (n - folds * size)) / size) + 1, F.lit(0)).cast("int")
    weight = F.exp(-0.003 * (n - i)) * (F.abs(ratio(F.col("later") - close, close)) + 0.001)
    targets = ahead.select("ticker", "day", F.when(F.col("later") > close, 1.0).otherwise(0.0).alias("label"), weight.alias("weight"), fold.alias("fold"))
    return vectors.join(targets, ["ticker", "day"])


@query("gbt_train_eval")
def gbt_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward training over five folds and calibrated metrics by fold (rows only)."""
    from tidemark.ml.train import walk_forward

    rows = cut(labelled(feature_vector_query(spark, sf_dir), view(spark, sf_dir, "bars_v"), 2, 5))
    return walk_forward(rows, list(DEFAULTS), 5)


@query("predict_persist")
def predict_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the days without a label yet, as they are kept: one for each ticker, day
    and horizon, a second run of a day adds none (rows only)."""
    from tidemark.ml.train import predict, train
    from tidemark.operators.upsert import insert_ignore

    vectors = cut(feature_vector_query(spark, sf_dir))
    rows = cut(labelled(vectors, view(spark, sf_dir, "bars_v"), 2, 5))
    fresh = vectors.join(rows.select("ticker", "day"), ["ticker", "day"], "left_anti")
    said = predict(train(rows, list(DEFAULTS)), fresh, ["ticker", "day"])
    made = said.withColumns({"horizon_days": F.lit(2), "resolve_after": F.date_add("day", 2), "is_correct": F.lit(None).cast("int")})
    return insert_ignore(made.where("false"), made, ["ticker", "day", "horizon_days"], [F.desc("confidence")])
