"""Document fingerprints (operator 10): bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's 5-word shingles (the
whole word sequence where it is shorter).  Sketches of parts merge into the sketch
of the whole: the k smallest of their union.  Two sketches estimate resemblance
(share of the union's k smallest that both have), containment and the number of
distinct shingles; under k shingles all of them are exact.

Edge cases: a null or empty text, or one without words, has the empty sketch; two
empty sketches resemble each other fully, an empty and another one not at all;
texts are taken whole; equal texts have equal fingerprints; rows with equal ids, or none (they
come last), follow each other by a hash of their texts; of one row alone it is its own
successor; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, boundaries, named
from tidemark.llm.kernels import gram_hashes, pieces

K, SHINGLE, HASH_BITS = 128, 5, 48
#: Sorts below every document's id; stands for a null one.
NO_ID = -(1 << 63)


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """Sorted sketch of each text."""
    out: list[np.ndarray] = []
    for piece in pieces(texts):
        words = piece.word_hashes() if len(piece.starts) else np.zeros(0, np.uint64)
        counts = np.diff(piece.row_words)
        grams, at = gram_hashes(words, piece.row_words, SHINGLE)
        bounds = np.searchsorted(at, piece.row_words)
        for i in range(piece.rows):
            own = grams[bounds[i] : bounds[i + 1]]
            if len(own) == 0 and counts[i]:
                own, _ = gram_hashes(words[piece.row_words[i] : piece.row_words[i + 1]], np.array([0, counts[i]]), int(counts[i]))
            own = own >> np.uint64(64 - HASH_BITS)
            if len(own) > 4 * k:  # repeats can make it too few: then all are sorted
                least = np.unique(np.partition(own, 2 * k)[: 2 * k])
                if len(least) >= k:
                    out.append(least[:k])
                    continue
            out.append(np.unique(own)[:k])
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.append(both[1:] == both[:-1], False)
    first = np.append(True, both[1:] != both[:-1])
    union = np.flatnonzero(first)[:k]
    return float(np.count_nonzero(twice[union]) / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact where the sketch isn't full."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) * float(1 << HASH_BITS) / (float(a[k - 1]) + 1)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if len(a) == 0:
        return 1.0
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, shared / distinct_shingles(a, k))


def to_text(sketch: np.ndarray) -> str:
    """Six bytes a hash, in base64: sorted, so equal sets give equal strings."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8 :]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, HASH_BITS // 8)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, 8 - HASH_BITS // 8 :] = raw
    return full.view(">u8").reshape(-1).astype(np.uint64)


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id and sketch (array of long) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s.astype(np.int64) for s in sketches(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, sketch array<bigint>")


def merge_sketches(parts: DataFrame, key: str, k: int = K, salts: int = 64) -> DataFrame:
    """The sketch of each key's union of parts (key, sketch).  Parts meet in salted groups
    first, so a key with very many parts doesn't gather them in one task."""
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, k).alias("sketch")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
    return salted.groupBy(key, "salt").agg(least).groupBy(key).agg(least)


def _order_cuts(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that cut the descending order of documents into n parts of about equal size, and
    into how many parts each one's own rows are cut besides (they are many where it repeats)."""
    shares = [i / n for i in range(1, n)]
    found = docs.select(F.percentile_approx("order_id", shares, 10 * max(n, 100)).alias("cuts")).first()[0] if shares else None
    ids, often = np.unique(np.array(found or [], dtype=np.int64), return_counts=True)
    return ids, often - 1


class _Parts:
    """Which part of the order (id descending, hash of the text ascending) a row is in."""

    def __init__(self, ids: np.ndarray, more: np.ndarray):
        self.ids, self.more = ids, more
        self.after = np.append(np.cumsum((1 + more)[::-1])[::-1], 0)  # parts that begin at this id or a larger one

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids, side="left")
        part = self.after[at]
        own = at < len(self.ids)
        own[own] = self.ids[at[own]] == ids[own]
        many = self.more[at[own]]
        # equal ids: their hashes' range in equal parts
        share = (hashes[own].astype(np.float64) + 2.0**63) / 2.0**64
        part[own] += np.minimum((share * (many + 1)).astype(np.int64), many) - many
        return part


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows part, ahead, doc_id, text: each document in its part of the descending order of
    ids, and the first one of the next part once more, as ahead, behind the last.

    A part has a bounded share of the rows, whatever ids repeat; the first document of all
    follows the last.  Only the cuts and the head of each part reach the driver.
    """
    base = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    base = base.withColumns({"order_id": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64(F.coalesce("text", F.lit("")))})
    dealing = _Parts(*_order_cuts(base, parts))
    n = int(dealing.after[0]) + 1

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = dealing.of(ids, hashes)
            order = np.lexsort((hashes, ~ids, part))  # ~ turns the order about for every number, NO_ID too: -NO_ID would be NO_ID
            order = order[boundaries([part[order]])]
            yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (part, ids, hashes)], ["part", "id", "th"])

    least = F.max_by(F.struct("id", "th"), F.struct("id", -F.col("th").cast("decimal(20,0)")))
    found = arrow_map(base.select("order_id", "th"), heads, "part bigint, id bigint, th bigint").groupBy("part").agg(least.alias("head"))
    head = sorted((r.part, r.head.id, r.head.th) for r in found.collect())  # one row for each part
    before = {h: head[i - 1][0] for i, (_, *h) in enumerate(head) for h in [tuple(h)]}  # the part that looks ahead to it; the last, for the first
    head_ids = np.unique(np.array([i for i, _ in before], dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            part, ahead = dealing.of(ids, hashes), np.zeros(len(ids), dtype=bool)
            some = np.flatnonzero(np.isin(ids, head_ids))
            first = {(ids[i], hashes[i]): i for i in some[::-1].tolist()}  # of equal rows one is enough
            twice = [(i, before[h]) for h, i in first.items() if h in before]
            part = np.concatenate([part, np.array([p for _, p in twice], dtype=np.int64)])
            ahead = np.concatenate([ahead, np.ones(len(twice), dtype=bool)])
            own = batch.take(pa.array(np.concatenate([np.arange(len(ids)), np.array([i for i, _ in twice], dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ahead), *own.columns], ["part", "ahead", "doc_id", "text", "order_id", "th"])

    placed = arrow_map(base, place, "part bigint, ahead boolean, doc_id bigint, text string, order_id bigint, th bigint")
    return placed.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "ahead", F.desc("order_id"), "th", "text")


def edited(text: str, following: str) -> str:
    """text, its last third replaced by as much of the beginning of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint each text, its edited text and its successor's, in one pass over the
    ordered documents; each task holds a batch and one document more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None  # (part, id, text, sketch) of the document that waits for its next
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                part, ahead, ids = (some.column(i).to_pylist() for i in range(3))
                column = some.column(3).fill_null("")
                texts, own = column.to_pylist(), sketches(column, k)
                pairs = []
                for p, a, i, t, s in zip(part, ahead, ids, texts, own, strict=True):
                    if last is not None:  # a document ahead stands at the end of a part only
                        pairs.append((last[1], last[2], last[3], t, s))
                    last = None if a else (p, i, t, s)
                if not pairs:
                    continue
                changed = pa.array([edited(t, nxt) for _, t, _, nxt, _ in pairs], pa.string())
                after = sketches(changed, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in pairs], pa.int64()),
                        pa.array([len(x[1]) for x in pairs], pa.int64()),
                        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed.to_pylist()]),
                        pa.array([to_text(x[2]) for x in pairs]),
                        pa.array([to_text(s) for s in after]),
                        pa.array([resemblance(x[2], s, k) for x, s in zip(pairs, after, strict=True)]),
                        pa.array([resemblance(x[2], x[4], k) for x in pairs]),
                    ],
                    names,
                )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(with_next(docs, id_col, text_col, parts).select("part", "ahead", "doc_id", "text"), compare, schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
