"""Upserts, set operations, calendars and other views over the relations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import upsert
from tidemark.plans.base import ORDERS_AS_OF, at, query, r6, table

_HALVES = "old as (select o_orderkey as id, o_custkey as name, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 3 <> 0), fresh as (select o_orderkey as id, o_custkey as name, 'N' as status, o_totalprice + 1 as price from orders where o_orderkey % 2 = 0)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two batches of one relation that share a third of their keys."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return orders.where("id % 3 <> 0"), orders.where("id % 2 = 0").withColumn("status", F.lit("N")).withColumn("price", F.col("price") + 1)


@query("upsert_replace", f"with {_HALVES} select * from fresh union all select * from old where id not in (select id from fresh)")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two rows of a batch with one key the later, here the dearer, stays."""
    old, new = halves(spark, sf_dir)
    return upsert.replace(old, new.withColumn("price", F.col("price") - 7).unionByName(new), ["id"], [F.desc("price")])


@query("insert_ignore", f"with {_HALVES} select * from old union all select * from fresh where id not in (select id from old)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = halves(spark, sf_dir)
    return upsert.insert_ignore(old, new.unionByName(new), ["id"], [F.col("id")])


@query("insert_if_new", f"with {_HALVES} select id, price from (select *, row_number() over (partition by price order by id) as r from fresh where id not in (select id from old) and price not in (select price from old)) where r = 1")
def insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New by every one of several keys."""
    old, new = halves(spark, sf_dir)
    return upsert.insert_new(old, new, ["price", "id"], [F.col("id")]).select("id", "price")


@query(
    "precedence_upsert",
    f"""with {_HALVES} select coalesce(o.id, n.id) as id, case when n.id is null or (o.id is not null and o.status = 'F') then o.status else n.status end as status,
    case when n.id is null or (o.id is not null and o.status = 'F') then coalesce(o.name, n.name) else coalesce(n.name, o.name) end as name, case when n.id is null or (o.id is not null and o.status = 'F') then o.price else n.price end as price from old o full join fresh n on o.id = n.id""",
)
def precedence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status F stands for the better source: it is kept, and only gets missing names filled."""
    old, new = halves(spark, sf_dir)
    return upsert.precedence(old, new, ["id"], "status", {"F": 2, "O": 1, "P": 1, "N": 1}, ["name"])


@query("coalesce_update", "select d.doc_id, coalesce(case when l.toxic = 1 then 'toxic' end, d.lang) as lang, d.source from documents d left join labels l using (doc_id)")
def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("lang"))
    return upsert.coalesce_update(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), delta, ["doc_id"])


@query("scd_deactivate", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_active from orders")
def scd_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = upsert.latest_active(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return active.select("o_orderkey", "o_custkey", "is_active")


@query("retention_delete", "select o_orderkey from orders where not (o_orderdate < timestamp '1996-01-01' or o_totalprice < 1000 or coalesce(nullif(o_orderstatus, 'P') = 'X', false))")
def retention_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    kept = upsert.delete_where(table(spark, sf_dir, "orders"), old, F.col("o_totalprice") < 1000, F.nullif(F.col("o_orderstatus"), F.lit("P")) == "X")
    return kept.select("o_orderkey")


@query("sectors_union_distinct", "select c_mktsegment as sector from customer union select p_type from part")
def sectors_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sector")).union(table(spark, sf_dir, "part").select("p_type")).distinct()


@query("events_left_info", "select o.o_orderkey, o.o_orderdate, coalesce(c.c_mktsegment, 'Unknown') as sector from orders o left join (select * from customer where c_custkey % 5 <> 0) c on c.c_custkey = o.o_custkey where o_orderdate between timestamp '1998-06-30' and timestamp '1998-07-30'")
def events_left_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    soon = table(spark, sf_dir, "orders").where("o_orderdate between timestamp_ntz '1998-06-30' and timestamp_ntz '1998-07-30'")
    return soon.join(info, "o_custkey", "left").select("o_orderkey", "o_orderdate", F.coalesce("c_mktsegment", F.lit("Unknown")).alias("sector"))


_CALENDAR = """select concat('ipo:', cast(o_orderkey as varchar)) as id, cast(o_orderdate as date) as day, 'ipo' as kind, o_orderpriority as title from orders where o_orderdate >= timestamp '1998-06-01' and o_orderdate < timestamp '1998-07-01'
union all select concat('event:', cast(event_id as varchar)), cast(ts as date) - 9331, 'event', event_type from events"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ipos = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1998-06-01' and o_orderdate < timestamp_ntz '1998-07-01'")
    events = table(spark, sf_dir, "events")
    return ipos.select(F.concat(F.lit("ipo:"), F.col("o_orderkey").cast("string")).alias("id"), F.to_date("o_orderdate").alias("day"), F.lit("ipo").alias("kind"), F.col("o_orderpriority").alias("title")).unionByName(
        events.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), F.date_sub(F.to_date("ts"), 9331).alias("day"), F.lit("event").alias("kind"), F.col("event_type").alias("title"))
    )


@query("calendar_union", _CALENDAR)
def calendar_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar in its order."""
    return calendar(spark, sf_dir).orderBy("day", "kind", "id")


_EVENTS = """old as (select o_orderkey as id, 'earnings' as kind, cast(o_orderdate as date) as day, o_orderpriority as title, case o_orderstatus when 'F' then 'confirmed' when 'O' then 'estimated' end as confidence,
case when o_orderkey % 2 = 0 then 'extracted' else 'manual' end as source, '' as notes from orders where o_orderkey % 3 <> 0), fresh as (select o_orderkey as id, 'earnings' as kind, cast(o_orderdate as date) as day, o_orderpriority as title, 'calendar notes' as notes from orders where o_orderkey % 4 < 2)"""


@query(
    "event_upgrade",
    f"""with {_EVENTS}, b as (select o.*, n.id is not null and o.source = 'extracted' and o.confidence is distinct from 'confirmed' as better from old o left join fresh n on n.id = o.id and n.kind = o.kind and n.day = o.day)
    select id, kind, day, title, case when better then 'confirmed' else confidence end as confidence, case when better then 'calendar' else source end as source, case when better then 'Upgraded from extracted to calendar confirmed' else notes end as notes from b
    union all select id, kind, day, title, 'confirmed', 'calendar', notes from fresh where id not in (select id from old)""",
)
def event_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar's events meet extracted ones: they confirm those, and add what is missing."""
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").alias("id"), F.lit("earnings").alias("kind"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"), "o_orderstatus")
    confidence = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "estimated")
    old = base.where("id % 3 <> 0").select("id", "kind", "day", "title", confidence.alias("confidence"), F.when(F.col("id") % 2 == 0, "extracted").otherwise("manual").alias("source"), F.lit("").alias("notes"))
    fresh = base.where("id % 4 < 2").select("id", "kind", "day", "title", F.lit("calendar notes").alias("notes"))
    return upsert.confirm(old, fresh, ["id", "kind", "day"], "calendar", "extracted")


@query(
    "upcoming_events",
    """select o.o_orderkey as id, cast(o_orderdate as date) as day, case o_orderstatus when 'F' then 'confirmed' when 'O' then 'estimated' end as confidence, c.c_mktsegment as sector
    from orders o left join (select * from customer where c_custkey % 5 <> 0) c on c.c_custkey = o.o_custkey where cast(o_orderdate as date) between date '1998-06-30' and date '1998-07-14'""",
)
def upcoming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the next 14 days with their sector, the nearest and best confirmed first."""
    info = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sector"))
    day = F.to_date("o_orderdate")
    first = ORDERS_AS_OF.date()
    soon = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(first + timedelta(days=15)).cast("timestamp_ntz")))
    confidence = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "estimated").alias("confidence")
    return soon.join(info, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), day.alias("day"), confidence, "sector").orderBy("day", F.desc("confidence"), "id")


@query("calendar_counts", f"select kind, count(*) as n, min(day) as first_day, max(day) as last_day from ({_CALENDAR}) group by kind")
def calendar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    "ipo_watchlist_order",
    "select o_orderkey, o_orderstatus, o_orderdate from orders order by case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end, case when o_orderkey % 11 = 0 then null else o_orderdate end asc nulls last, o_totalprice desc, o_orderkey limit 100",
)
def ipo_watchlist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    day = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").orderBy(status, F.asc_nulls_last(day), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("ipo_plausibility", "select o_orderkey from orders where o_orderstatus <> 'F' and coalesce(date_diff('day', cast(o_orderdate as date), date '1998-06-30') <= 90, true)")
def ipo_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not public already, and not announced too long ago; an unknown date passes."""
    recent = F.coalesce(F.datediff(F.lit(date(1998, 6, 30)), F.to_date("o_orderdate")) <= 90, F.lit(True))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & recent).select("o_orderkey")


@query("active_forecasts", "select o_custkey, count(*) as n, round(avg(o_totalprice), 2) as mean_price from orders where o_orderdate + interval 30 day >= timestamp '1998-06-30 23:59:59' and o_orderdate <= timestamp '1998-06-30 23:59:59' group by o_custkey")
def active_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made by then that have not expired: 30 days after they were made."""
    live = (F.col("o_orderdate") + F.expr("interval 30 days") >= at(ORDERS_AS_OF)) & (F.col("o_orderdate") <= at(ORDERS_AS_OF))
    return table(spark, sf_dir, "orders").where(live).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("reflections_filter", "select o_orderkey, o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 20")
def reflections_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction of the filters that are given."""
    given = {"o_orderpriority": "1-URGENT", "o_orderstatus": "F", "o_custkey": None}
    rows = table(spark, sf_dir, "orders")
    for column, value in given.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


@query("pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price, round(avg(l_discount), 6) as avg_discount, count(*) as n from lineitem where l_shipdate <= timestamp '2001-06-30' group by 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2001-06-30'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"), r6(F.avg("l_discount")).alias("avg_discount"), F.count("*").alias("n"))
