"""Enrichers: functions on batches of texts, plugged in where a model would be called.

An enricher gets a list of strings and returns a list of equal length; null where it
has no answer, which leaves the row as it was.  A batch whose call fails is left
unanswered rather than failing the job, and counts an attempt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.functions.text import has_keyword

Embedder = Callable[[Sequence[str]], Sequence[list[float] | None]]

#: Words for each kind of news, tried in this order; authored for this engine.
KINDS = (("earnings", ("earnings", "revenue", "profit", "guidance")), ("deal", ("merger", "acquisition", "buyback")), ("macro", ("inflation", "interest rate", "central bank", "bond yield")), ("market", ("stock", "shares", "market cap", "dividend")))


def hash_embedder(texts: Sequence[str]) -> list[list[float] | None]:
    """Deterministic unit vectors of eight numbers, for runs without a model."""
    out: list[list[float] | None] = []
    for t in texts:
        raw = [b - 127.5 for b in hashlib.sha256(t.encode()).digest()[:8]]
        size = sum(x * x for x in raw) ** 0.5
        out.append([x / size for x in raw] if t else None)
    return out


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder = hash_embedder, batch: int = 100) -> DataFrame:
    """key, embedding and attempts (1 if the call failed or gave nothing), batch texts to a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for first in range(0, some.num_rows, batch):
                part = some.slice(first, batch)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                try:
                    vectors = list(embedder(texts))
                except Exception:  # noqa: BLE001  a model's failure is data here: the rows are tried again
                    vectors = [None] * len(texts)
                if len(vectors) != len(texts):
                    vectors = [None] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([int(v is None) for v in vectors], pa.int32())], ["key", "embedding", "attempts"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, embedding array<float>, attempts int")


def rule_kind(text: Column) -> Column:
    """The first kind of news whose words occur; noise without any."""
    out = F.lit("noise")
    for kind, some in reversed(KINDS):
        out = F.when(has_keyword(text, some), kind).otherwise(out)
    return out


def tally(text: Column, some: Sequence[str]) -> Column:
    """How many of the words a text contains."""
    lowered = F.lower(text)
    listed = F.array(*(F.lit(w) for w in some))
    return F.size(F.filter(listed, lambda w: F.contains(lowered, w))).cast("long")


def lean(text: Column, margin: int = 1) -> Column:
    """Which side a text argues for, by its words; neutral within the margin."""
    d = tally(text, words.BULLISH) - tally(text, words.BEARISH)
    return F.when(d >= margin, "bullish").when(d <= -margin, "bearish").otherwise("neutral")


#: Fixed value: what a row says that was no work for a model.
NOISE_SUMMARY = "Filtered out by pre-classification noise heuristics."


def mark_noise(rows: DataFrame, is_noise: Column) -> DataFrame:
    """rows with the verdict on those that are noise; the others stay as they are."""
    noise = F.coalesce(is_noise, F.lit(False))
    verdict = {"event_type": "noise", "sentiment_score": 0.0, "urgency": "low", "suggested_direction": "neutral", "classification_summary": NOISE_SUMMARY}
    return rows.withColumns({c: F.when(noise, F.lit(v)).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c, v in verdict.items()})


#: Answers that are worth another try, by status and by words of the failure; a bad answer is not.
TRANSIENT_STATUS = (408, 429, 500, 502, 503, 504)
TRANSIENT_WORDS = ("timeout", "timed out", "connection", "rate limit", "unavailable", "overloaded")


def is_transient(status: Column, message: Column) -> Column:
    """Whether a failed call may come through if it is tried again."""
    told = F.lower(F.coalesce(message, F.lit("")))
    words_ = F.lit(False)
    for w in TRANSIENT_WORDS:
        words_ = words_ | F.contains(told, F.lit(w))
    return F.coalesce(status.isin(*TRANSIENT_STATUS), F.lit(False)) | words_


def token_usage(explicit: Column, by_meta: Column, by_usage: Column) -> Column:
    """Tokens of a call: as stated, else by the answer's usage metadata, else by its usage (each a struct of prompt and
    candidate); a part that nobody tells is 0. An answer with metadata is not asked for its usage."""
    told = F.when(by_meta.isNotNull(), by_meta).otherwise(by_usage)
    return F.struct(*(F.coalesce(explicit[c], told[c], F.lit(0)).cast("long").alias(c) for c in ("prompt", "candidate")))


def has_consensus(turns: DataFrame, keys: list[str], side: str, text: str, order: str, bull: str = "bull", bear: str = "bear") -> DataFrame:
    """keys and consensus of each debate: whether its two sides lean one way by their last statements,
    so that a further round has no use. Without a statement of either side there is none."""
    last = turns.where(F.col(side).isin(bull, bear)).groupBy(*keys, F.col(side).alias("side")).agg(F.max_by(text, order).alias("said"))
    ahead = F.when(F.col("side") == bull, tally(F.col("said"), words.BULLISH) > tally(F.col("said"), words.BEARISH)).otherwise(tally(F.col("said"), words.BEARISH) > tally(F.col("said"), words.BULLISH))
    sides = last.select(*keys, "side", ahead.alias("ahead")).groupBy(*keys).agg(*(F.max(F.when(F.col("side") == s, F.col("ahead"))).alias(n) for s, n in ((bull, "bullish"), (bear, "bearish"))))
    both = turns.select(*keys).distinct().join(sides, keys, "left")
    return both.select(*keys, F.coalesce(~F.col("bullish") & ~F.col("bearish"), F.lit(False)).alias("consensus"))  # neither holds its side


ANSWER = "event_type string, sentiment_score double, urgency string, suggested_direction string, affected_tickers array<string>"


def validated(answers: DataFrame, column: str) -> DataFrame:
    """Model answers as typed columns and whether they hold to the contract; a bad answer is
    kept apart as a row, not an error of its batch."""
    parsed = answers.withColumn("answer", F.from_json(column, ANSWER, {"allowUnquotedControlChars": "true"}))
    score = F.col("answer.sentiment_score")
    good = score.between(-1, 1) & F.col("answer.urgency").isin("low", "medium", "high", "critical") & F.col("answer.suggested_direction").isin("bullish", "bearish", "neutral")
    return parsed.withColumn("valid", F.coalesce(good, F.lit(False)))
