"""Vector code compression (operator 11): product quantization by Hamerly's Lloyd iteration.

Vectors become whole numbers (llm/vectors.py) and are cut into PARTS equal consecutive
parts.  Each part position has a codebook of ENTRIES entries, at first those parts of the
vectors with the smallest ids.  A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by the floor of its
parts' mean; entries without parts stay.

Assignments are kept from round to round in a table, with two bounds for each part: one not
below the distance to its entry, and one not above the distance to any other.  When entries
have moved, both bounds give way by how far; a part is compared with all entries only where the
bounds, the first of them made exact, don't lie strictly apart, so ties are always settled by the
full scan.  Distances are integers; bounds are rounded to the safe side.

Spark: one pass for each round over a table of integer vectors and their state, without a shuffle of
vectors.  A task's sums for each entry (PARTS x ENTRIES rows at most) meet in an aggregate; the codebooks
(of fixed size) are all that the driver sees.

Edge cases: vectors that are null or hold null or non-finite components are left out; shorter ones
count as followed by zeros; fewer than ENTRIES vectors make as many entries; rows of equal ids are coded
one by one (in the first codebook they follow each other by their components), rows without an id come last there;
null labels are one label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, cut, discard, join_of_keys, named, shuffles_end
from tidemark.llm.vectors import lists, matrix, whole_numbers

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that are compared with all entries at once.
_STRIP = 4096
_STATE = "vec_id bigint, label_none boolean, label_value string, v array<int>, code array<int>, upper array<float>, lower array<float>"


class Codebooks(NamedTuple):
    """entries: part x entry x position in part."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def moved(self, then: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """How far each entry has moved since then, and for each the farthest of the others; rounded up."""
        far = np.sqrt(((self.entries - then.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)
        others = np.zeros_like(far)
        if far.shape[1] > 1:
            rank = np.argsort(-far, axis=1, kind="stable")
            first, second = (np.take_along_axis(far, rank[:, k : k + 1], 1) for k in (0, 1))
            others[:] = first
            np.put_along_axis(others, rank[:, :1], second, 1)
        return far, others


def _up(x: np.ndarray) -> np.ndarray:
    """float32 numbers not below x."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """float32 numbers not above x, 0 at least."""
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties to the lower index), its squared
    distance and that of the second nearest (of the nearest, with one entry)."""
    far = np.zeros((len(parts), len(entries)), dtype=np.int64)
    for k in range(parts.shape[1]):
        apart = parts[:, k : k + 1] - entries[:, k]
        far += apart * apart
    best = far.argmin(axis=1)
    rows = np.arange(len(parts))
    least = far[rows, best]
    if len(entries) > 1:
        far[rows, best] = np.iinfo(np.int64).max
    return best, least, far.min(axis=1)


def first_codes(v: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bounds of each vector, by comparison with all entries."""
    n, (parts, _, width) = len(v), books.entries.shape
    code, upper, lower = np.empty((n, parts), np.int64), np.empty((n, parts), np.float32), np.empty((n, parts), np.float32)
    for p in range(parts):
        own = v[:, p * width : (p + 1) * width]
        for first in range(0, n, _STRIP):
            some = slice(first, first + _STRIP)
            code[some, p], least, second = nearest(own[some], books.entries[p])
            upper[some, p], lower[some, p] = _up(np.sqrt(least)), _down(np.sqrt(second))
    return code, upper, lower


def next_codes(v: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks, then: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved from then to books, and how many parts were compared with all."""
    code, width, compared = code.copy(), books.entries.shape[2], 0
    far, others = books.moved(then)
    of_part = np.arange(code.shape[1])
    upper = _up(upper.astype(np.float64) + far[of_part, code])
    lower = _down(np.maximum(lower.astype(np.float64) - others[of_part, code], 0))
    for p in of_part:
        doubt = np.flatnonzero(~(upper[:, p] < lower[:, p]))
        if not len(doubt):
            continue
        own = v[doubt, p * width : (p + 1) * width]
        exact = ((own - books.entries[p][code[doubt, p]]) ** 2).sum(axis=1)
        upper[doubt, p] = _up(np.sqrt(exact))
        still = ~(upper[doubt, p] < lower[doubt, p])
        doubt, own = doubt[still], own[still]
        compared += len(doubt)
        for first in range(0, len(doubt), _STRIP):
            rows = doubt[first : first + _STRIP]
            code[rows, p], least, second = nearest(own[first : first + _STRIP], books.entries[p])
            upper[rows, p], lower[rows, p] = _up(np.sqrt(least)), _down(np.sqrt(second))
    return code, upper, lower, compared


def _first_books(vectors: DataFrame, length: int, parts: int, entries: int) -> Codebooks:
    """Of the vectors with the smallest ids: as many rows as a codebook has entries reach the driver."""
    with shuffles_end(vectors.sparkSession):
        least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    v = np.array([r.v for r in least], dtype=np.int64).reshape(len(least), parts, length // parts)
    return Codebooks(v.transpose(1, 0, 2).copy())


def _next_books(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of its parts."""
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            v, code = matrix(batch.column(0), parts * width), matrix(batch.column(1), parts)
            at = (code + np.arange(parts) * entries).reshape(-1)
            count += np.bincount(at, minlength=parts * entries)
            np.add.at(total, at, v.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists(total[used], pa.int64())], ["at", "n", "total"])

    found = arrow_map(state.select("v", "code"), sums, "at bigint, n bigint, total array<bigint>")
    total = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)]
    out = books.entries.copy().reshape(-1, width)
    with shuffles_end(state.sparkSession):
        for r in found.groupBy("at").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows at most
            out[r["at"]] = [int(r[f"t{k}"]) // r.n for k in range(width)]
    return Codebooks(out.reshape(books.entries.shape))


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label_none, label_value, code (array of entry indexes), error of each kept vector, and
    the codebooks; None without a vector.  The table is one that cut() wrote."""
    label = named(label_col).cast("string")
    rows, length = whole_numbers(vectors.select(named(id_col).cast("long").alias("vec_id"), label.isNull().alias("label_none"), F.coalesce(label, F.lit("")).alias("label_value"), named(vector_col).alias("vector")), "vector", parts)
    whole = cut(rows.drop("vector"))
    books = _first_books(whole, length, parts, entries)
    out_schema = "vec_id bigint, label_none boolean, label_value string, code array<int>, error bigint"
    if not books.entries.shape[1]:
        discard(whole)
        return cut(vectors.sparkSession.createDataFrame([], out_schema)), None
    then, state = None, whole

    def assign(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), length)
            if then is None:
                code, upper, lower = first_codes(v, books)
            else:
                old = matrix(batch.column("code"), parts), matrix(batch.column("upper"), parts, np.float32), matrix(batch.column("lower"), parts, np.float32)
                code, upper, lower, _ = next_codes(v, *old, books, then)
            own = [batch.column(k) for k in ("vec_id", "label_none", "label_value")]
            if last:
                entry = books.entries[np.arange(parts), code].reshape(v.shape)
                yield pa.RecordBatch.from_arrays([*own, lists(code, pa.int32()), pa.array(((v - entry) ** 2).sum(axis=1))], ["vec_id", "label_none", "label_value", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*own, batch.column("v"), lists(code, pa.int32()), lists(upper, pa.float32()), lists(lower, pa.float32())], ["vec_id", "label_none", "label_value", "v", "code", "upper", "lower"])

    for r in range(rounds + 1):
        last = r == rounds
        new = cut(arrow_map(state, lambda batches, last=last: assign(batches, last), out_schema if last else _STATE))
        discard(state)
        state = new
        if not last:
            then, books = books, _next_books(state, books)
    return state, books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    keys = ["label_none", "label_value"]
    by_label = cut(coded.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows of label")))
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return join_of_keys(coded, by_label, keys, "rows of label").select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
