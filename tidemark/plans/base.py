"""How queries are registered, and the domain views over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Every view of time-dependent data is taken at a stated time, never at the clock's.
EVENTS_AS_OF = datetime(2024, 1, 25)
ORDERS_AS_OF = datetime(1998, 6, 30, 23, 59, 59)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The engine's relations as seen in the test tables; the same text runs in Spark and DuckDB.
VIEWS = {
    "mentions_v": "select concat('T', cast(user_id % 20 as string)) as ticker, event_id as article_id, (value - 250) / 250 as sentiment_score, case cast(event_id % 4 as int) when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as urgency, ts as mentioned_at from {events}",
    "sector_v": "select distinct concat('T', cast(user_id % 20 as string)) as ticker, case cast(user_id % 5 as int) when 0 then 'Technology' when 1 then 'Energy' when 2 then 'Health' when 3 then 'Finance' else 'Consumer' end as sector from {events}",
    "usage_v": "select event_id as id, ts, event_type as model_name, concat('op', cast(user_id % 5 as string)) as operation, cast(floor(value * 10) as bigint) as prompt_tokens, cast(event_id % 300 as bigint) as candidate_tokens, case when event_type = 'error' then 1 else 0 end as is_error, cast(event_id % 900 as bigint) as latency_ms from {events}",
    "bars_v": "select event_type as ticker, cast(ts as date) as bar_date, min_by(value, ts) as open, max(value) as high, min(value) as low, max_by(value, ts) as close, count(*) as volume from {events} group by event_type, cast(ts as date)",
    "articles_v": "select d.doc_id as id, substring(d.text, 1, 80) as headline, d.text as summary, d.source as source_name, d.lang as country, timestamp '2024-01-01 00:00:00' + cast(concat(cast((d.doc_id * 37) % 43200 as string), ' minutes') as interval) as published_at, case when l.quality = 0 then 'noise' when l.quality is null then null else 'general' end as event_type, case when l.doc_id is null then null else ((d.doc_id * 53) % 201 - 100) / cast(100 as double) end as sentiment_score, case when l.quality = 1 then ((d.doc_id * 17) % 101) / cast(10 as double) end as importance_score from {documents} d left join {labels} l on d.doc_id = l.doc_id",
    "insider_v": "select concat(cast(l_orderkey as string), '_', cast(l_linenumber as string)) as line_key, concat('S', cast(l_suppkey % 50 as string)) as ticker, concat('P', cast(l_partkey as string)) as insider_name, cast(l_shipdate as date) as transaction_date, l_shipdate + interval '2' day as filed_at, case l_returnflag when 'A' then 'P' when 'R' then 'S' else 'M' end as transaction_code, case when l_returnflag in ('A','R') then 1 else 0 end as is_discretionary, case l_returnflag when 'A' then l_extendedprice when 'R' then -l_extendedprice end as value_usd from {lineitem}",
    "predictions_v": "select o_orderkey as id, concat('T', cast(o_custkey % 50 as string)) as ticker, case when o_totalprice >= 150000 then 'UP' else 'DOWN' end as predicted_direction, o_orderpriority as model_type, o_orderdate as created_at, cast(o_orderdate as date) + 5 as resolve_after, case o_orderstatus when 'F' then 1 when 'O' then 0 end as is_correct from {orders}",
    "flows_v": "select concat('S', cast(l_suppkey % 50 as string)) as ticker, cast(l_shipdate as date) as trade_date, sum(case when l_linestatus = 'F' then l_quantity else -l_quantity end) as inst_net, sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as foreign_net, sum(l_quantity) as total_value from {lineitem} group by l_suppkey % 50, cast(l_shipdate as date)",
    "vec_v": "select vec_id as id, embedding, label, timestamp '2024-01-01 00:00:00' + cast(concat(cast(vec_id as string), ' hours') as interval) as published_at from {embeddings}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    found = spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})
    # times without a zone, as in the tables
    return found.select(*(F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in found.dtypes))


def with_views(sql: str, *names: str) -> str:
    """sql over views, as one DuckDB statement."""
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    if not parts:
        return sql
    lead = "with recursive " if sql.lstrip().lower().startswith("with recursive") else "with "
    body = sql.lstrip()
    for word in ("with recursive ", "with "):
        if body.lower().startswith(word):
            return lead + ", ".join(parts) + ", " + body[len(word) :]
    return lead + ", ".join(parts) + " " + body


def query(name: str, oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL over the named views where SQL can say it."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_views(oracle, *views)
        return fn

    return keep


def at(when: datetime) -> Column:
    """A literal time without a zone, as the tables hold them."""
    return F.lit(when).cast("timestamp_ntz")


def r6(column: Column) -> Column:
    return F.round(column, 6)
