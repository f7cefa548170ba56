"""Filings, prices, flows and calendars from landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import end_of_day

_CHART = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>"


def price_bars(landed: DataFrame) -> DataFrame:
    """Daily bars from a chart answer's parallel arrays; bars without a close are left out."""
    result = landed.select(F.explode(F.from_json("payload", _CHART)["chart"]["result"]).alias("r"))
    quote = F.col("r.indicators.quote")[0]
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), quote["open"].alias("open"), quote["high"].alias("high"), quote["low"].alias("low"), quote["close"].alias("close"), quote["volume"].alias("volume"))
    rows = result.select(F.col("r.meta.symbol").alias("ticker"), F.explode(zipped).alias("b")).where("b.close is not null")
    return rows.select("ticker", F.to_date(F.timestamp_seconds("b.t")).alias("date"), *(F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))


_INDEX = "cik string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,primaryDocument:array<string>>>"


def filing_index(landed: DataFrame, forms: tuple[str, ...], since: str | None = None) -> DataFrame:
    """One row for each filing of a form, amendments (`form/A`) with it."""
    parsed = landed.select(F.from_json("payload", _INDEX).alias("x"))
    recent = F.col("x.filings.recent")
    rows = parsed.select(F.lpad("x.cik", 10, "0").alias("cik"), F.inline(F.arrays_zip(recent["accessionNumber"].alias("accession_no"), recent["form"].alias("form"), recent["filingDate"].alias("filed"), recent["primaryDocument"].alias("document"))))
    form = F.upper("form")
    kept = rows.where(form.isin(*forms) | F.split(form, "/")[0].isin(*forms)).withColumn("filed_on", F.try_to_date("filed")).drop("filed")
    kept = kept.where(F.col("filed_on") >= F.lit(since).cast("date")) if since else kept
    return kept.withColumn("is_amendment", F.col("form").contains("/A")).withColumn("filed_at", end_of_day(F.col("filed_on")))


def cik_map(landed: DataFrame) -> DataFrame:
    """ticker, cik of ten digits, from an object of objects."""
    entries = landed.select(F.explode(F.map_values(F.from_json("payload", "map<string,struct<cik_str:bigint,ticker:string,title:string>>"))).alias("x"))
    return entries.select(F.upper("x.ticker").alias("ticker"), F.lpad(F.col("x.cik_str").cast("string"), 10, "0").alias("cik"), F.col("x.title").alias("name"))


_VALUE = "struct<value:string>"
_FORM4 = (
    "issuer struct<issuerCik:string,issuerTradingSymbol:string>, "
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>>, aff10b5One string, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VALUE}>>>>"
)


def _flag(column: Column) -> Column:
    """1, true and their opposites; what isn't said stays unknown."""
    c = F.lower(F.trim(column))
    return F.when(c.isin("1", "true"), True).when(c.isin("0", "false"), False)


def form4(landed: DataFrame) -> DataFrame:
    """One row for each transaction of an ownership document (payload, accession_no, filed_at);
    money is negative for disposals."""
    doc = landed.withColumn("x", F.from_xml("payload", _FORM4))
    rows = doc.select("accession_no", "filed_at", "x", F.posexplode("x.nonDerivativeTable.nonDerivativeTransaction").alias("n", "t"))
    owner = F.col("x.reportingOwner")[0]
    relation = owner["reportingOwnerRelationship"]
    shares, price = F.col("t.transactionAmounts.transactionShares.value").try_cast("double"), F.col("t.transactionAmounts.transactionPricePerShare.value").try_cast("double")
    sign = F.when(F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value") == "D", -1.0).otherwise(1.0)
    code = F.col("t.transactionCoding.transactionCode")
    return rows.select(
        F.concat_ws("_", "accession_no", F.col("n").cast("string")).alias("id"),
        F.upper("x.issuer.issuerTradingSymbol").alias("ticker"),
        F.lpad("x.issuer.issuerCik", 10, "0").alias("issuer_cik"),
        owner["reportingOwnerId"]["rptOwnerName"].alias("insider_name"),
        relation["officerTitle"].alias("insider_title"),
        F.coalesce(_flag(relation["isOfficer"]), F.lit(False)).alias("is_officer"),
        F.coalesce(_flag(relation["isDirector"]), F.lit(False)).alias("is_director"),
        F.coalesce(_flag(relation["isTenPercentOwner"]), F.lit(False)).alias("is_ten_pct_owner"),
        F.try_to_date(F.substring("t.transactionDate.value", 1, 10)).alias("transaction_date"),
        "filed_at",
        code.alias("transaction_code"),
        F.coalesce(code.isin("P", "S"), F.lit(False)).alias("is_discretionary"),
        shares.alias("shares"),
        price.alias("price_per_share"),
        (sign * shares * price).alias("value_usd"),
        F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").try_cast("double").alias("shares_owned_after"),
        _flag(F.col("x.aff10b5One")).alias("is_10b5_1"),
        "accession_no",
    )


def stakes(index: DataFrame, names: DataFrame) -> DataFrame:
    """Ownership stakes from an index of SC 13 forms; the filer is the accession number's head."""
    base = F.split("form", "/")[0]
    return index.join(names, "cik", "left").select(
        F.col("accession_no").alias("id"), "ticker", F.split("accession_no", "-")[0].alias("filer_cik"), F.col("form").alias("form_type"), (base == "SC 13D").alias("is_activist"), "is_amendment", "filed_at", "accession_no"
    )


def kr_flows(landed: DataFrame) -> DataFrame:
    """Rows of a flow table (ticker, payload): a date and five numbers at least; a day is taken once."""
    rows = landed.select("ticker", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    day = F.regexp_extract("row", r"(\d{4}\.\d{2}\.\d{2})", 1)
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[,\s+]", ""))
    numbers = F.filter(F.transform(cells, lambda c: F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("double"))), lambda n: n.isNotNull())
    found = rows.select("ticker", F.try_to_date(F.nullif(day, F.lit("")), "yyyy.MM.dd").alias("trade_date"), numbers.alias("v")).where("trade_date is not null and size(v) >= 5")
    # close, volume, institutions, foreigners, held
    typed = found.select("ticker", "trade_date", F.col("v")[2].alias("inst_net"), F.col("v")[3].alias("foreign_net"), F.col("v")[1].alias("total_value"))
    return typed.groupBy("ticker", "trade_date").agg(*(F.min(c).alias(c) for c in ("inst_net", "foreign_net", "total_value")))


def earnings_calendar(landed: DataFrame) -> DataFrame:
    rows = landed.select(F.explode(F.from_json("payload", "earningsCalendar array<struct<symbol:string,date:string,quarter:int,year:int,hour:string>>")["earningsCalendar"]).alias("x"))
    when = F.when(F.col("x.hour") == "bmo", "before open").when(F.col("x.hour") == "amc", "after close").when(F.col("x.hour") == "dmh", "during hours")
    title = F.when(F.col("x.quarter").isNotNull() & F.col("x.year").isNotNull(), F.concat("x.symbol", F.lit(" Q"), F.col("x.quarter").cast("string"), F.lit(" FY"), F.col("x.year").cast("string"), F.lit(" earnings"))).otherwise(F.concat("x.symbol", F.lit(" earnings")))
    out = rows.select(F.upper("x.symbol").alias("ticker"), F.lit("earnings").alias("event_type"), F.try_to_date("x.date").alias("event_date"), title.alias("event_title"), F.lit("confirmed").alias("confidence"), F.lit("finnhub").alias("source"), when.alias("notes"))
    return out.where("ticker is not null and event_date is not null")


def ipo_calendar(landed: DataFrame) -> DataFrame:
    """Announced offerings; prices stay text, as they may be ranges."""
    rows = landed.select(F.explode(F.from_json("payload", "ipoCalendar array<struct<symbol:string,name:string,date:string,price:string,totalSharesValue:double,status:string>>")["ipoCalendar"]).alias("x"))
    status = F.when(F.col("x.status") == "priced", "priced").when(F.col("x.status") == "withdrawn", "withdrawn").otherwise("expected")
    kept = rows.where("x.name is not null and coalesce(x.status, '') <> 'filed'")
    return kept.select(F.col("x.name").alias("company_name"), F.upper("x.symbol").alias("ticker"), F.try_to_date("x.date").alias("ipo_date"), F.nullif(F.col("x.price"), F.lit("")).alias("offering_price"), F.col("x.totalSharesValue").alias("estimated_valuation"), status.alias("status"))


def web_results(landed: DataFrame, most: int = 5) -> DataFrame:
    from tidemark.functions.text import domain, truncate_words

    rows = landed.select(F.posexplode(F.from_json("payload", "results array<struct<title:string,url:string,content:string>>")["results"]).alias("n", "x")).where(F.col("n") < most)
    return rows.select((F.col("n") + 1).alias("place"), F.col("x.title").alias("title"), F.col("x.url").alias("url"), domain(F.col("x.url")).alias("domain"), truncate_words(F.col("x.content"), 400).alias("snippet"))
