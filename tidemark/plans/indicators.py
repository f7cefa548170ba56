"""Technical indicators over daily bars: one window pass over (ticker, date) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ewm import ewm_mean
from tidemark.plans.base import query, r6, table, view


def series() -> Window:
    return Window.partitionBy("ticker").orderBy("bar_date")


def last(n: int) -> Window:
    return series().rowsBetween(-(n - 1), 0)


def full(value: Column, column: str, n: int) -> Column:
    """The value where n rows are there, else null."""
    return F.when(F.count(column).over(last(n)) == n, value)


def _ohlc(events: DataFrame, bucket: Column) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("ticker"), bucket.alias("bucket")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )


_OHLC_SQL = "select event_type as ticker, {0} as bucket, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as volume from events group by 1, 2"


@query("ohlcv_daily", _OHLC_SQL.format("cast(ts as date)"))
def ohlcv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(table(spark, sf_dir, "events"), F.to_date("ts"))


@query("ohlcv_hourly", _OHLC_SQL.format("date_trunc('hour', ts)"))
def ohlcv_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(table(spark, sf_dir, "events"), F.date_trunc("hour", "ts").cast("timestamp_ntz"))


_W = "over (partition by ticker order by bar_date rows between {} preceding and current row)"


def _w(n: int) -> str:
    return _W.format(n - 1)


@query("sma_20", f"select ticker, bar_date, round(avg(close) {_w(20)}, 6) as sma_any, round(case when count(*) {_w(20)} = 20 then avg(close) {_w(20)} end, 6) as sma_20 from bars_v", "bars_v")
def sma_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("close").over(last(20))
    return view(spark, sf_dir, "bars_v").select("ticker", "bar_date", r6(mean).alias("sma_any"), r6(full(mean, "close", 20)).alias("sma_20"))


@query(
    "bollinger_20",
    f"select ticker, bar_date, round(m + 2 * s, 6) as upper, round(m - 2 * s, 6) as lower, round(4 * s / m, 6) as width from (select *, avg(close) {_w(20)} as m, stddev_samp(close) {_w(20)} as s, count(*) {_w(20)} as n from bars_v) where n = 20",
    "bars_v",
)
def bollinger_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "bars_v").select("ticker", "bar_date", F.avg("close").over(last(20)).alias("m"), F.stddev_samp("close").over(last(20)).alias("s"), F.count("*").over(last(20)).alias("n")).where("n = 20")
    m, s = F.col("m"), F.col("s")
    return rows.select("ticker", "bar_date", r6(m + 2 * s).alias("upper"), r6(m - 2 * s).alias("lower"), r6(4 * s / m).alias("width"))


def moves(bars: DataFrame) -> DataFrame:
    change = F.col("close") - F.lag("close").over(series())
    up, down = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))  # greatest() would make the first, unknown one 0
    return bars.withColumn("gain", F.when(change.isNotNull(), up)).withColumn("loss", F.when(change.isNotNull(), down))


_MOVES_SQL = "(select *, greatest(close - lag(close) over (partition by ticker order by bar_date), 0) as gain, greatest(lag(close) over (partition by ticker order by bar_date) - close, 0) as loss, row_number() over (partition by ticker order by bar_date) as i from bars_v)".replace(
    "greatest(close - lag(close) over (partition by ticker order by bar_date), 0)", "case when lag(close) over (partition by ticker order by bar_date) is not null then greatest(close - lag(close) over (partition by ticker order by bar_date), 0) end"
).replace("greatest(lag(close) over (partition by ticker order by bar_date) - close, 0)", "case when lag(close) over (partition by ticker order by bar_date) is not null then greatest(lag(close) over (partition by ticker order by bar_date) - close, 0) end")


@query(
    "rsi_14_simple",
    f"select ticker, bar_date, round(case when l = 0 then 100 else 100 - 100 / (1 + g / l) end, 6) as rsi from (select *, avg(gain) {_w(14)} as g, avg(loss) {_w(14)} as l, count(gain) {_w(14)} as n from {_MOVES_SQL}) where n = 14",
    "bars_v",
)
def rsi_14_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple means of 14 moves; 100 where nothing was lost."""
    rows = moves(view(spark, sf_dir, "bars_v")).select("ticker", "bar_date", F.avg("gain").over(last(14)).alias("g"), F.avg("loss").over(last(14)).alias("l"), F.count("gain").over(last(14)).alias("n"))
    rsi = F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("g", "l")))
    return rows.where("n = 14").select("ticker", "bar_date", r6(rsi).alias("rsi"))


@query(
    "rsi_14_chart",
    f"select ticker, bar_date, round(case when n = 14 and not (g = 0 and l = 0) then case when l = 0 then 100 else 100 - 100 / (1 + g / l) end end, 6) as rsi from (select *, avg(coalesce(gain, 0)) {_w(14)} as g, avg(coalesce(loss, 0)) {_w(14)} as l, count(*) {_w(14)} as n from {_MOVES_SQL})",
    "bars_v",
)
def rsi_14_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charted variant: the first move counts as 0, so values begin at row 14; 0/0 is null."""
    g, loss = F.avg(F.coalesce("gain", F.lit(0.0))).over(last(14)), F.avg(F.coalesce("loss", F.lit(0.0))).over(last(14))
    rows = moves(view(spark, sf_dir, "bars_v")).select("ticker", "bar_date", g.alias("g"), loss.alias("l"), F.count("*").over(last(14)).alias("n"))
    rsi = F.when(F.col("l") == 0, F.when(F.col("g") > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide("g", "l")))
    return rows.select("ticker", "bar_date", r6(F.when(F.col("n") == 14, rsi)).alias("rsi"))


@query(
    "atr_14",
    f"select ticker, bar_date, round(avg(tr) {_w(14)}, 6) as atr from (select *, greatest(high - low, coalesce(abs(high - p), high - low), coalesce(abs(low - p), high - low)) as tr from (select *, lag(close) over (partition by ticker order by bar_date) as p from bars_v))",
    "bars_v",
)
def atr_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """greatest() skips nulls, so the first true range is high less low."""
    before = F.lag("close").over(series())
    ranged = view(spark, sf_dir, "bars_v").withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return ranged.select("ticker", "bar_date", r6(F.avg("tr").over(last(14))).alias("atr"))


@query(
    "macd_12_26_9",
    """with recursive b as (select ticker, bar_date, close, row_number() over (partition by ticker order by bar_date) as i from bars_v),
    e as (select ticker, bar_date, i, close as f, close as s from b where i = 1 union all select b.ticker, b.bar_date, b.i, b.close * 2 / 13 + e.f * 11 / 13, b.close * 2 / 27 + e.s * 25 / 27 from e join b on b.ticker = e.ticker and b.i = e.i + 1),
    g as (select ticker, bar_date, i, f - s as macd, f - s as signal from e where i = 1 union all select e.ticker, e.bar_date, e.i, e.f - e.s, (e.f - e.s) * 0.2::double + g.signal * 0.8::double from g join e on e.ticker = g.ticker and e.i = g.i + 1)
    select ticker, bar_date, round(macd, 6) as macd, round(signal, 6) as signal, round(macd - signal, 6) as histogram from g""",
    "bars_v",
)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = view(spark, sf_dir, "bars_v").select("ticker", "bar_date", "close")
    for span, name in ((12, "fast"), (26, "slow")):
        bars = ewm_mean(bars, "close", ["ticker"], ["bar_date"], span, name)
    lined = ewm_mean(bars.withColumn("line", F.col("fast") - F.col("slow")), "line", ["ticker"], ["bar_date"], 9, "mean")
    return lined.select("ticker", "bar_date", r6("line").alias("macd"), r6("mean").alias("signal"), r6(F.col("line") - F.col("mean")).alias("histogram"))


@query(
    "returns_volatility",
    f"""select ticker, bar_date, round(r, 6) as return_1d, round((close - coalesce(l5, f)) / coalesce(l5, f), 6) as return_5d, round(coalesce(stddev_pop(r) {_w(20)}, 0), 6) as volatility_20, round(close / avg(close) {_w(20)} - 1, 6) as sma_gap from (
    select *, (close - lag(close) over w) / lag(close) over w as r, lag(close, 5) over w as l5, first_value(close) over w as f from bars_v window w as (partition by ticker order by bar_date))""",
    "bars_v",
)
def returns_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One- and five-day returns (from the first close where five days aren't there), population deviation of the last 20."""
    close, before = F.col("close"), F.lag("close").over(series())
    bars = view(spark, sf_dir, "bars_v").withColumn("r", (close - before) / before).withColumn("base", F.coalesce(F.lag("close", 5).over(series()), F.first("close").over(series())))
    return bars.select(
        "ticker", "bar_date", r6("r").alias("return_1d"), r6((close - F.col("base")) / F.col("base")).alias("return_5d"), r6(F.coalesce(F.stddev_pop("r").over(last(20)), F.lit(0.0))).alias("volatility_20"), r6(close / F.avg("close").over(last(20)) - 1).alias("sma_gap")
    )


@query(
    "volume_anomaly",
    "select ticker, bar_date, volume, round(m, 6) as mean_before, coalesce(volume > 1.2::double * m, false) as anomaly from (select *, avg(volume) over (partition by ticker order by bar_date rows between unbounded preceding and 1 preceding) as m from bars_v)",
    "bars_v",
)
def volume_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume against the mean of the days before it."""
    mean = F.avg("volume").over(series().rowsBetween(Window.unboundedPreceding, -1))
    bars = view(spark, sf_dir, "bars_v").withColumn("m", mean)
    return bars.select("ticker", "bar_date", "volume", r6("m").alias("mean_before"), F.coalesce(F.col("volume") > 1.2 * F.col("m"), F.lit(False)).alias("anomaly"))


@query(
    "price_move_alerts",
    "select ticker, bar_date, round(pct, 6) as pct from (select *, 100 * (close - lag(close) over (partition by ticker order by bar_date)) / lag(close) over (partition by ticker order by bar_date) as pct from bars_v) where abs(pct) >= 5 and not (day(bar_date) % 5 = 0)",
    "bars_v",
)
def price_move_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large moves, once a day: days with an alert already are left out."""
    bars = view(spark, sf_dir, "bars_v")
    sent = bars.where(F.dayofmonth("bar_date") % 5 == 0).select("ticker", "bar_date")
    before = F.lag("close").over(series())
    moved = bars.withColumn("pct", 100 * (F.col("close") - before) / before).where("abs(pct) >= 5")
    return moved.join(sent, ["ticker", "bar_date"], "left_anti").select("ticker", "bar_date", r6("pct").alias("pct"))


def _labelled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from the 21st on with the next close, l."""
    later, i = F.lead("close", 1).over(series()), F.row_number().over(series())
    return view(spark, sf_dir, "bars_v").withColumn("l", later).withColumn("i", i).where("i > 20 and l is not null").drop("i")


@query(
    "forward_labels",
    "select ticker, bar_date, case when l > close then 1 else 0 end as label, round((l - close) / close, 6) as forward_return from (select *, lead(close, 1) over (partition by ticker order by bar_date) as l, row_number() over (partition by ticker order by bar_date) as i from bars_v) where i > 20 and l is not null",
    "bars_v",
)
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next close is higher, from the 21st bar on: the windows of the features are full by then."""
    rows = _labelled_bars(spark, sf_dir)
    return rows.select("ticker", "bar_date", F.when(F.col("l") > F.col("close"), 1).otherwise(0).alias("label"), r6((F.col("l") - F.col("close")) / F.col("close")).alias("forward_return"))


@query(
    "timeseries_folds",
    """select ticker, bar_date, greatest(0, cast(floor((i - 1 - (n - 5 * s)) / s) as bigint) + 1) as fold, round(exp(-0.003::double * (n - i)) * (abs(r) + 0.001), 6) as weight from (select *, greatest(1, floor(n / 6)) as s from (
    select ticker, bar_date, (l - close) / close as r, row_number() over (partition by ticker order by bar_date) as i, count(*) over (partition by ticker) as n from (select *, lead(close, 1) over (partition by ticker order by bar_date) as l, row_number() over (partition by ticker order by bar_date) as k from bars_v) where k > 20 and l is not null))""",
    "bars_v",
)
def timeseries_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five walk-forward folds of the labelled bars: 0 is only trained on, fold k is tested after all before
    it; weights fade with age and grow with the move."""
    i, n = F.row_number().over(series()), F.count("*").over(Window.partitionBy("ticker"))
    move = F.abs((F.col("l") - F.col("close")) / F.col("close")) + 0.001
    rows = _labelled_bars(spark, sf_dir).select("ticker", "bar_date", move.alias("move"), i.alias("i"), n.alias("n")).withColumn("size", F.greatest(F.lit(1), F.floor(F.col("n") / 6)))
    fold = F.greatest(F.lit(0), F.floor((F.col("i") - 1 - (F.col("n") - 5 * F.col("size"))) / F.col("size")) + 1)
    return rows.select("ticker", "bar_date", fold.cast("long").alias("fold"), r6(F.exp(-0.003 * (F.col("n") - F.col("i"))) * F.col("move")).alias("weight"))


@query(
    "fast_heuristic",
    "select ticker, bar_date, case when c > 0 then 'UP' else 'DOWN' end as direction, round(least(0.52::double + 2 * abs(c), 0.85::double), 6) as confidence from (select *, (close - lag(close) over (partition by ticker order by bar_date)) / lag(close) over (partition by ticker order by bar_date) as c from bars_v) where c is not null",
    "bars_v",
)
def fast_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("close").over(series())
    rows = view(spark, sf_dir, "bars_v").withColumn("c", (F.col("close") - before) / before).where("c is not null")
    return rows.select("ticker", "bar_date", F.when(F.col("c") > 0, "UP").otherwise("DOWN").alias("direction"), r6(F.least(0.52 + 2 * F.abs("c"), F.lit(0.85))).alias("confidence"))


@query("weekly_change", "select ticker, date_trunc('week', bar_date)::date as week, round(100 * (arg_max(close, bar_date) - arg_min(close, bar_date)) / arg_min(close, bar_date), 6) as pct from bars_v group by 1, 2", "bars_v")
def weekly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, newest = F.min_by("close", "bar_date"), F.max_by("close", "bar_date")
    return view(spark, sf_dir, "bars_v").groupBy("ticker", F.to_date(F.date_trunc("week", "bar_date")).alias("week")).agg(r6(100 * (newest - first) / first).alias("pct"))
