"""Companies going public, as calendars and scans tell of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.entities import merge_listings
from tidemark.plans.base import query, table


@query(
    "ipo_listings",
    """with old as (select s_suppkey as k, s_suppkey as id, s_name || case when s_suppkey % 2 = 0 then ', Inc.' else '' end as company_name, 'T' || s_suppkey as ticker, 'filed' as status,
      case when s_suppkey % 3 <> 0 then 'known' end as sector, null::varchar as valuation, case when s_suppkey % 4 = 0 then 'finnhub' end as source from supplier),
    new as (select o_custkey % 150 as k, o_orderkey as n, 'Supplier#' || lpad((o_custkey % 150)::varchar, 9, '0') || case o_orderkey % 3 when 0 then '' when 1 then ', Inc.' else ' Corp' end as company_name,
      case when o_orderkey % 5 <> 0 then 'N' || o_orderkey end as ticker, o_orderstatus as status, case when o_orderkey % 4 = 0 then o_orderpriority end as sector, case when o_orderkey % 6 = 0 then floor(o_totalprice)::bigint::varchar end as valuation,
      case when o_orderkey % 211 = 0 then 'finnhub' when o_orderkey % 2 = 0 then 'llm' end as source from orders),
    told as (select k, arg_min(company_name, n) as first_name, max(n) filter (where source = 'finnhub') as best_n, max(n) as any_n, max(n) filter (where sector is not null) as sector_n, max(n) filter (where valuation is not null) as valuation_n, arg_max(source, n) filter (where source is not null) as said from new group by k),
    decided as (select coalesce(o.k, t.k) as k, o.id, coalesce(o.company_name, t.first_name) as company_name, o.ticker as old_ticker, o.status as old_status, o.sector as old_sector, o.valuation as old_valuation, o.source as old_source, t.*exclude (k, first_name),
      case when best_n is not null then best_n when coalesce(o.source, '') <> 'finnhub' then any_n end as over_n from old o full join told t on o.k = t.k)
    select d.id, d.company_name, case when over_n is null then old_ticker else f.ticker end as ticker, case when over_n is null then old_status else f.status end as status,
      case when sector_n is not null and (over_n is null or sector_n > over_n) then s.sector when over_n is null then old_sector else f.sector end as sector,
      case when valuation_n is not null and (over_n is null or valuation_n > over_n) then v.valuation when over_n is null then old_valuation else f.valuation end as valuation,
      case when old_source = 'finnhub' or best_n is not null then 'finnhub' else coalesce(said, old_source) end as source
    from decided d left join new f on f.n = over_n left join new s on s.n = sector_n left join new v on v.n = valuation_n""",
)
def ipo_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listed companies, some by the calendar; orders as records that tell of them and of
    others, under several spellings of their names."""
    k = F.col("s_suppkey")
    old = table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        F.concat("s_name", F.when(k % 2 == 0, ", Inc.").otherwise("")).alias("company_name"),
        F.concat(F.lit("T"), k).alias("ticker"),
        F.lit("filed").alias("status"),
        F.when(k % 3 != 0, "known").alias("sector"),
        F.lit(None).cast("string").alias("valuation"),
        F.when(k % 4 == 0, "finnhub").alias("source"),
    )
    n = F.col("o_orderkey")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 150).cast("string"), 9, "0"), F.when(n % 3 == 0, "").when(n % 3 == 1, ", Inc.").otherwise(" Corp"))
    new = table(spark, sf_dir, "orders").select(
        n.alias("n"),
        name.alias("company_name"),
        F.when(n % 5 != 0, F.concat(F.lit("N"), n)).alias("ticker"),
        F.col("o_orderstatus").alias("status"),
        F.when(n % 4 == 0, F.col("o_orderpriority")).alias("sector"),
        F.when(n % 6 == 0, F.floor("o_totalprice").cast("bigint").cast("string")).alias("valuation"),
        F.when(n % 211 == 0, "finnhub").when(n % 2 == 0, "llm").alias("source"),
    )
    return merge_listings(old, new, "n")
