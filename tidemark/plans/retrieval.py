"""Vector search, re-ranking and semantic deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import band_join
from tidemark.operators.knn import nearest, nearest_in_band
from tidemark.operators.topk import top_per_group
from tidemark.plans.base import query, r6, table, view

#: Similarity from which two texts tell the same; the test vectors are all further apart than in production.
THETA, DAYS = 0.35, 3

_COS = "list_cosine_similarity({0}::double[], {1}::double[])"


@query(
    "knn_top10",
    f"select query_id, r as rank, id, round(sim, 6) as similarity from (select q.vec_id as query_id, e.vec_id as id, {_COS.format('q.embedding', 'e.embedding')} as sim, row_number() over (partition by q.vec_id order by round({_COS.format('q.embedding', 'e.embedding')}, 9) desc, e.vec_id) as r from embeddings q, embeddings e where q.vec_id % 50 = 0) where r <= 10",
)
def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    found = nearest(vectors, vectors.where("id % 50 = 0"), 10)
    return found.withColumn("similarity", r6("similarity"))


@query(
    "knn_rerank",
    f"""select query_id, id, quality, round(sim, 6) as similarity from (select *, row_number() over (partition by query_id order by quality desc nulls last, round(sim, 9) desc, id) as p from (
    select k.*, l.quality from (select q.vec_id as query_id, e.vec_id as id, {_COS.format('q.embedding', 'e.embedding')} as sim, row_number() over (partition by q.vec_id order by round({_COS.format('q.embedding', 'e.embedding')}, 9) desc, e.vec_id) as r
    from embeddings q, embeddings e where q.vec_id % 50 = 0) k left join labels l on l.doc_id = k.id where r <= 20)) where p <= 5""",
)
def knn_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest, re-ranked by quality, of which 5 stay."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    near = nearest(vectors, vectors.where("id % 50 = 0"), 20)
    labelled = near.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    best = top_per_group(labelled, ["query_id"], [F.desc_nulls_last("quality"), F.desc(F.round("similarity", 9)), F.col("id")], 5, "place")
    return best.select("query_id", "id", "quality", r6(F.col("similarity")).alias("similarity"))


def duplicates(vectors: DataFrame, keep: str, theta: float = THETA, days: int = DAYS) -> DataFrame:
    """id, duplicate_of, similarity of flagged rows: neighbours are rows published within some days of each other and similar.

    keep 'earliest': a row with an earlier neighbour is a duplicate of the nearest such.

    keep 'greedy': rows are taken oldest first, each is flagged if a neighbour is not
    flagged yet, and points to the nearest such.  This needs no sequential pass: a
    row's later neighbours are never flagged when its turn comes, so every row with
    one is flagged; a row without has earlier neighbours only, all of which had
    itself as a later one and were flagged, so it stays.  Hence a row is flagged
    just if it has a later neighbour, and points to the nearest of these.
    """
    found = nearest_in_band(vectors, theta, days, earlier=keep == "earliest")
    return found.select("id", F.col("other").alias("duplicate_of"), r6(F.col("similarity")).alias("similarity"))


_PAIRS = f"(select x.id as a, y.id as b, {_COS.format('x.embedding', 'y.embedding')} as sim from vec_v x join vec_v y on x.published_at < y.published_at and y.published_at <= x.published_at + interval 3 day)"


@query("dedup_earliest_wins", f"select b as id, arg_max(a, (round(sim, 9), -a)) as duplicate_of, round(max(sim), 6) as similarity from {_PAIRS} where sim > 0.35 group by b", "vec_v")
def dedup_earliest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(view(spark, sf_dir, "vec_v"), "earliest")


@query("dedup_greedy", f"select a as id, arg_max(b, (round(sim, 9), -b)) as duplicate_of, round(max(sim), 6) as similarity from {_PAIRS} where sim > 0.35 group by a", "vec_v")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(view(spark, sf_dir, "vec_v"), "greedy")


@query("backlog_dedup", "select id, published_at from vec_v where id % 3 <> 0 order by published_at, id limit 200", "vec_v")
def backlog_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch to compare: embedded, never compared (here: not id % 3 = 0), oldest first."""
    return view(spark, sf_dir, "vec_v").where("id % 3 <> 0").orderBy("published_at", "id").limit(200).select("id", "published_at")


@query(
    "band_join_3d",
    "select o.o_orderkey, count(*) as near from orders o join orders p on p.o_custkey = o.o_custkey and p.o_orderkey <> o.o_orderkey and abs(date_diff('microsecond', o.o_orderdate, p.o_orderdate)) <= 3 * 86400000000::bigint group by o.o_orderkey",
)
def band_join_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    left = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("t"))
    right = orders.select(F.col("o_orderkey").alias("other"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("u"))
    same: list[Column] = [F.col("o_custkey") == F.col("cust"), F.col("o_orderkey") != F.col("other")]
    return band_join(left, right, "t", "u", 3, same).groupBy("o_orderkey").agg(F.count("*").alias("near"))


@query(
    "retrieve_context",
    f"""select query_id, string_agg(text, ' | ' order by r) as context from (select k.query_id, k.r, d.text, row_number() over (partition by k.query_id order by k.r) as p from (select q.vec_id as query_id, e.vec_id as id,
    row_number() over (partition by q.vec_id order by round({_COS.format('q.embedding', 'e.embedding')}, 9) desc, e.vec_id) as r from embeddings q, embeddings e where q.vec_id % 50 = 0) k join documents d on d.doc_id = k.id where k.r <= 20) where p <= 5 group by query_id""",
)
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the 5 nearest of each query's 20 candidates that have one, best first, as one context."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    near = nearest(vectors, vectors.where("id % 50 = 0"), 20)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"])
    return top_per_group(near.join(texts, "id"), ["query_id"], [F.col("rank")], 5, "place").groupBy("query_id").agg(F.array_join(ordered, " | ").alias("context"))
