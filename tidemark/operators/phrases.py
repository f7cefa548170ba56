"""Many phrases at once: an Aho-Corasick automaton, broadcast, over texts in Arrow batches.

The phrases are a table (code, phrase, strict): a strict one counts as it is written only, the others in
any case. Every phrase is counted on its own, as whole words, without overlaps with itself; where
one lies in another both count. An automaton holds MOST phrases at most; a larger table is dealt in parts
that take their turns over the texts, so what is broadcast has a bound and the counts are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

#: Phrases of one automaton, and characters of them.
MOST, MOST_CHARACTERS = 1 << 16, 1 << 22


def folded(text: str) -> str:
    """text in small letters, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Phrases:
    """Finds phrases; made of (code, phrase, strict)."""

    def __init__(self, phrases: Sequence[tuple[str, str, bool]]):
        self.phrases = list(dict.fromkeys(phrases))
        by_form: dict[str, list[int]] = {}
        for i, (_, phrase, _) in enumerate(self.phrases):
            by_form.setdefault(folded(phrase), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for form, own in by_form.items():
            self.automaton.add_word(form, (len(form), own))
        self.automaton.make_automaton()

    def count(self, text: str) -> Counter:
        """Hits of each code."""
        hits: Counter = Counter()
        if not self.phrases:
            return hits
        low, ends = folded(text), {}
        for last, (length, own) in self.automaton.iter(low):
            first, end = last - length + 1, last + 1
            if (first and _word(low[first - 1])) or (end < len(low) and _word(low[end])):
                continue
            for i in own:
                code, phrase, strict = self.phrases[i]
                if first < ends.get(i, 0) or (strict and text[first:end] != phrase):
                    continue
                ends[i] = end
                hits[code] += 1
        return hits


def parts_of(phrases: DataFrame) -> list[list[tuple[str, str, bool]]]:
    """The phrases in parts of a bounded size; without those that are null or empty."""
    known = phrases.select("code", "phrase", F.coalesce("strict", F.lit(False)).alias("strict")).where("code is not null and phrase <> ''").distinct()
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("phrase")).alias("characters")).first()
    n = max(-(-size.n * 2 // MOST), -(-(size.characters or 0) * 2 // MOST_CHARACTERS), 1)
    dealt = known.withColumn("part", F.pmod(F.xxhash64("code", "phrase", "strict"), F.lit(n)))
    return [[tuple(r)[:3] for r in (dealt if n == 1 else dealt.where(F.col("part") == k)).collect()] for k in range(n)]


def count_phrases(docs: DataFrame, phrases: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with hits: how often the phrases of each code are in the text. A null text has none."""
    spark, out = docs.sparkSession, docs.withColumn("hits", F.create_map().cast("map<string,bigint>"))
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema, StructField("hits", MapType(StringType(), LongType()))])
    kind = pa.map_(pa.string(), pa.int64())
    for part in parts_of(phrases):
        shared = spark.sparkContext.broadcast(part)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Phrases(shared.value)
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                hits = [list((Counter(dict(b or ())) + found.count(t or "")).items()) for b, t in zip(before, batch.column(at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], names=batch.schema.names)

        out = out.mapInArrow(count, schema)
    return out


def top_codes(docs: DataFrame, top: int = 3) -> DataFrame:
    """docs with codes in place of hits: at most top, the most frequent first, ties by code."""
    ranked = F.array_sort(F.transform(F.map_entries("hits"), lambda x: F.struct((-x["value"]).alias("less"), x["key"].alias("code"))))
    return docs.withColumn("codes", F.transform(F.slice(ranked, 1, top), lambda x: x["code"])).drop("hits")
