"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, copies."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def corpus(seed: int = 3, n: int = 90) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = {"en": "the of and that with thing ention edly", "de": "der die und nicht schlich ung keit eine", "fr": "le de la que eau ment tion euxai"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(vocabulary))
        text = "\n".join(" ".join(rng.choice(vocabulary[lang].split()) + rng.choice(["", "", "er", "én"]) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, lang if i % 6 else None, f"s{i % 4}" if i % 9 else None, len(text)))
    rows += [(200 + k, rows[5][1], "en", "s1", len(rows[5][1])) for k in range(7)]  # exact copies
    rows += [(300 + k, rows[6][1] + f" x{k}", "de", "s2", None) for k in range(5)]  # near copies
    long = " ".join(f"w{rng.randint(0, 400)}" for _ in range(9000))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \n\t ", "en", "s1", 4), (403, long, "en", "s3", len(long)), (404, "123 456 !!", None, "s0", 10), (405, "Ünï\U0001f4a3中文 mixed", "fr", "s0", 12)]
    rows += [rows[8], rows[8]]  # one row thrice
    rows += [(None, "text without an id the of and", "en", "s1", 29)]
    return rows


def frame(spark, rows=None, extra: bool = True):
    """The corpus as documents, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    if extra:
        for name in ("fp", "token", "words", "size", "did", "th", "n", "group", "part", "pattern", "score", "keep_text"):
            docs = docs.withColumn(name, F.lit(1))
    return docs.repartition(3)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
