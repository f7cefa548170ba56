"""Rule-based enrichment, answer validation, term index, model fallback and the ingest cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.operators import enrich
from tidemark.plans.base import query, r6, table
from tidemark.streaming import ingest, windows


def _any(some: tuple[str, ...]) -> str:
    return r"(^|\W)(?:" + "|".join(some) + r")(\W|$)"


@query("rule_classify", "select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{_any(w)}') then '{k}'" for k, w in enrich.KINDS) + " else 'noise' end as event_type from documents")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", enrich.rule_kind(F.col("text")).alias("event_type"))


def _sum(some: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::bigint" for w in some)


#: Turns argue by rule: each third one for a rise, each third for a fall.
_ARGUED_SQL = "select conv_id, turn, role, text || case (conv_id + turn) % 3 when 0 then ' Strong growth, upside and a rally' when 1 then ' Downside risk: weak, overvalued' else ' buy or sell' end as text from conversations"


def _argued(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    more = F.when(k == 0, " Strong growth, upside and a rally").when(k == 1, " Downside risk: weak, overvalued").otherwise(" buy or sell")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", more).alias("text"))


@query(
    "debate_tally",
    f"select *, case when bullish - bearish >= 1 then 'bullish' when bullish - bearish <= -1 then 'bearish' else 'neutral' end as lean from (select conv_id, turn, {_sum(words.BULLISH)} as bullish, {_sum(words.BEARISH)} as bearish from ({_ARGUED_SQL}))",
)
def debate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _argued(spark, sf_dir).select("conv_id", "turn", enrich.tally(t, words.BULLISH).alias("bullish"), enrich.tally(t, words.BEARISH).alias("bearish"), enrich.lean(t).alias("lean"))


@query(
    "debate_consensus",
    f"""with tallied as (select conv_id, turn, role, {_sum(words.BULLISH)} as bullish, {_sum(words.BEARISH)} as bearish from ({_ARGUED_SQL})),
    last as (select conv_id, arg_max(bullish > bearish, turn) filter (where role = 'user') as bull, arg_max(bearish > bullish, turn) filter (where role = 'assistant') as bear from tallied group by 1)
    select conv_id, coalesce(not bull and not bear, false) as consensus from last""",
)
def debate_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether users and assistants, as two sides, lean one way by their last turns."""
    return enrich.has_consensus(_argued(spark, sf_dir), ["conv_id"], "role", "text", "turn", "user", "assistant")


@query(
    "answer_validation",
    "select event_type, count(*) filter (where event_id % 7 <> 0 and event_id % 5 <> 0 and abs((value - 250) / 200) <= 1) as valid, count(*) as total from events group by event_type",
)
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events: some broken, some with an unknown urgency, some out of range."""
    number = ((F.col("value") - 250) / 200).cast("string")
    urgency = F.when(F.col("event_id") % 5 == 0, "whenever").otherwise("high")
    text = F.concat(F.lit('{"event_type":"x","sentiment_score":'), number, F.lit(',"urgency":"'), urgency, F.lit('","suggested_direction":"neutral","affected_tickers":["A"]'), F.when(F.col("event_id") % 7 != 0, "}").otherwise(""))
    answers = table(spark, sf_dir, "events").select("event_type", text.alias("text"))
    return enrich.validated(answers, "text").groupBy("event_type").agg(F.count_if("valid").alias("valid"), F.count("*").alias("total"))


@query(
    "term_index",
    r"select term, doc_id, count(*) as n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\pL\pM\pN_]+')) as term from documents) where term <> '' group by 1, 2",
)
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all terms, in any script: term, document, occurrences."""
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\pL\pM\pN_]+")).alias("term")).where(F.col("term") != "")
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("n"))


@query(
    "model_fallback",
    "select c_custkey, case when c_custkey % 10 = 0 then 'ticker' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'sector' when c_acctbal > 0 then 'universal' else 'none' end as model from customer",
)
def model_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific model that there is: own, the sector's, the common one, or none."""
    names = table(spark, sf_dir, "customer")
    own = names.where("c_custkey % 10 = 0").select("c_custkey", F.lit("ticker").alias("own"))
    of_sector = spark.createDataFrame([("BUILDING", "sector"), ("MACHINERY", "sector")], "c_mktsegment string, of_sector string")
    joined = names.join(own, "c_custkey", "left").join(F.broadcast(of_sector), "c_mktsegment", "left")
    return joined.select("c_custkey", F.coalesce("own", "of_sector", F.when(F.col("c_acctbal") > 0, "universal"), F.lit("none")).alias("model"))


@query("embed_batches")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents by a pluggable embedder (rows only); nearest to the first coordinate."""
    found = enrich.embed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), r6(F.col("embedding")[0].cast("double")).alias("first"), "attempts")


@query("stream_ingest", "select urgency, count(*) as n, count(*) filter (where importance = 1.0) as dull from (select case when value > 400 then 'high' when value > 100 then 'medium' else 'low' end as urgency, case when value <= 100 then 1.0 else value / 50 end as importance from events) group by urgency")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the stages of the cycle: classify, rank with the low-signal shortcut, append if new."""
    classify = lambda df: df.withColumn("urgency", F.when(F.col("value") > 400, "high").when(F.col("value") > 100, "medium").otherwise("low"))
    rank = lambda df: df.withColumn("importance", F.when(F.col("urgency") == "low", 1.0).otherwise(F.col("value") / 50))
    where = windows.checkpoint(spark)
    for k in range(2):  # the second run finds nothing new
        ingest.run(windows.read_events(spark, sf_dir), [classify, rank], f"{where}/out", f"{where}/state{k}", "event_id", "ts")
    landed = spark.read.parquet(f"{where}/out")
    return landed.groupBy("urgency").agg(F.count("*").alias("n"), F.count_if(F.col("importance") == 1.0).alias("dull"))
