"""Exact nearest neighbours by inverted lists: of a stated set of queries, and of each row within a band of time.

Vectors are taken at unit length. Every row is in the list of its nearest centroid; a list's radius is the greatest
distance of a row from its centroid, so by Cauchy-Schwarz no row of it is more similar to a query than
the centroid is, plus the radius. Lists that can't hold a result are not visited: what is found is exact, whatever the centroids are. They are fitted
by k-means on SAMPLE rows or so; tables of up to a block are one list.

Near lists are put together in parts of half a block of rows to a block, so that a query comes once for that many
rows, not once for each list; longer ones are dealt in blocks by a hash. Within bands of time only a band of more
than a block is parted: rows of the others meet by band alone. A row is written once, to its block; queries go to
the blocks that they visit and stream past them, so a task holds one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.operators.lineage import cut

#: Rows of a block, rows that centroids are fitted on, lists at most, lists that all queries visit first, queries compared at once.
BLOCK, SAMPLE, MOST_LISTS, FIRST, TILE = 4096, 16_384, 1024, 8, 256
#: Similarities differ in their last digits by the order of adding.
SLACK = 1e-8


#: Bits of a list's place in the tree of parts.
DEPTH = 12


class Lists(NamedTuple):
    """What the driver knows of an index: each list's centroid, radius and place in the tree of parts (ascending), and the number of rows."""

    centroids: np.ndarray
    radius: np.ndarray
    path: np.ndarray
    rows: int

    def parts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts of a depth, and where the lists of each begin."""
        return np.unique(self.path >> (DEPTH - depth), return_index=True)

    def bounds(self, queries: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """The most that a row of each part can be similar to each query."""
        if len(self.radius) == 1:  # of all rows
            return np.full((len(queries), 1), 1 + SLACK)
        return np.maximum.reduceat(queries @ self.centroids.T + self.radius + SLACK, self.parts(depth)[1], axis=1)


def _depth(n: int, block: int) -> int:
    """Halvings of n rows that leave half a block or more in a part."""
    return max(0, min(DEPTH, (2 * n // block).bit_length() - 1))


def _paths(centroids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places of lists in a tree: halved by their rows, across the direction in which they are widest."""
    path = np.zeros(len(rows), dtype=np.int64)

    def halve(some: np.ndarray, bits: int, at: int) -> None:
        path[some] = at << bits
        if not bits or len(some) < 2:
            return
        apart = centroids[some] - centroids[some].mean(axis=0)
        some = some[np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")]
        before = np.cumsum(rows[some])
        middle = min(max(int(np.searchsorted(before, before[-1] / 2)), 1), len(some) - 1)
        halve(some[:middle], bits - 1, 2 * at)
        halve(some[middle:], bits - 1, 2 * at + 1)

    halve(np.arange(len(rows)), DEPTH, 0)
    return path


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def unit_rows(rows: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """id, v (of length one) and further columns of the rows whose vector has a length."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    sized = rows.where(F.col(vector_col).isNotNull()).withColumn("length of v", size).where((F.col("length of v") > 0) & (F.col("length of v") < F.lit(float("inf"))))
    return sized.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x / F.col("length of v")).alias("v"), *more)


def index(rows: DataFrame, block: int | None = None) -> tuple[DataFrame, Lists]:
    """The rows (id, v, ...) with the path of their list, and the lists; a table that is written."""
    rows = cut(rows)
    n, block = rows.count(), block or BLOCK
    if n <= block:
        return rows.withColumn("path", F.lit(0)), Lists(np.zeros((1, 0)), np.ones(1), np.zeros(1, dtype=np.int64), n)
    share = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 32)) < F.lit(int((1 << 32) * min(1.0, SAMPLE / n)) + 1)
    model = KMeans(k=max(2, min(isqrt(n), MOST_LISTS)), maxIter=4, initSteps=1, seed=42).fit(rows.where(share).select(array_to_vector("v").alias("features")))
    centroids = np.array(model.clusterCenters(), dtype=np.float64)
    half = (centroids**2).sum(axis=1) / 2
    at = rows.columns.index("v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(at))
                own = (v @ centroids.T - half).argmax(axis=1)
                far = np.sqrt(((v - centroids[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], [*batch.schema.names, "list", "far"])

    kept = cut(rows.mapInArrow(assign, StructType([*rows.schema, StructField("list", IntegerType()), StructField("far", DoubleType())])))
    found = sorted(kept.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("rows")).collect())  # MOST_LISTS rows at most
    own, radius, often = (np.array(x) for x in zip(*found, strict=True))
    path = _paths(centroids[own], often)
    order = np.argsort(path, kind="stable")
    placed = rows.sparkSession.createDataFrame(list(zip(own.tolist(), path.tolist(), strict=True)), "list int, path int")
    return kept.drop("far").join(F.broadcast(placed), "list").drop("list"), Lists(centroids[own[order]], radius[order], path[order], n)


def _visiting(queries: DataFrame, lists: Lists, chosen: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], depth: int | None = DEPTH) -> DataFrame:
    """Each query once for each part of that depth (None: of its column depth) that it visits: chosen tells which, given the bounds."""
    at = queries.columns.index("v")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TILE):
                tile = batch.slice(first, TILE)
                depths = np.full(tile.num_rows, depth) if depth is not None else tile.column("depth").to_numpy()
                for d in np.unique(depths).tolist():
                    some = tile.take(pa.array(np.flatnonzero(depths == d)))
                    i, j = np.nonzero(chosen(some, lists.bounds(_matrix(some.column(at)), d)))
                    out = some.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.parts(d)[0][j].astype(np.int32))], [*some.schema.names, "part"])

    return queries.mapInArrow(visit, StructType([*queries.schema, StructField("part", IntegerType())]))


def _met(rows: DataFrame, visits: DataFrame, cell: list[str], compare: Callable[[dict, dict], pa.RecordBatch | None], schema: str, block: int | None = None) -> DataFrame:
    """What compare gives where rows and visits meet in the cells; those of over a block are dealt in blocks."""
    half = (block or BLOCK) / 2
    # a row for each block's rows or more
    large = F.broadcast(cut(rows.groupBy(*cell).agg(F.floor(F.count("*") / half).cast("int").alias("blocks")).where("blocks > 1")))
    blocks = F.coalesce("blocks", F.lit(1))
    own = rows.join(large, cell, "left").withColumn("block", F.pmod(F.xxhash64("id", "v"), blocks).cast("int")).withColumn("comes", F.lit(False)).drop("blocks")
    coming = visits.join(large, cell, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("comes", F.lit(True)).drop("blocks")
    return _compared(own.unionByName(coming, allowMissingColumns=True), [*cell, "block"], compare, schema)


def _compared(dealt: DataFrame, keys: list[str], compare: Callable[[dict, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What compare (of a block's columns and some queries') gives for each block, the rows of equal keys that don't come, and those that do."""
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "comes", "id")
    names = dealt.columns

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            marks = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in (*keys, "comes")]
            edges = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1 if batch.num_rows else []
            for first, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if first == end:
                    continue
                run, own = batch.slice(first, end - first), tuple(m[first] for m in marks[:-1])
                if own != key:
                    key, held = own, []
                if not marks[-1][first]:
                    held.append(run)
                elif held:
                    if isinstance(held, list):
                        held = _columns(pa.Table.from_batches(held).combine_chunks().to_batches()[0], names)
                    for at in range(0, run.num_rows, TILE):
                        found = compare(held, _columns(run.slice(at, TILE), names))
                        if found is not None:
                            yield found

    return dealt.mapInArrow(meet, schema)


def _columns(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {c: _matrix(batch.column(i)) if c == "v" else batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}


_FOUND = "query_id bigint, id bigint, similarity double"


def _best(k: int) -> Callable[[dict, dict], pa.RecordBatch]:
    def compare(block: dict, some: dict) -> pa.RecordBatch:
        sims = some["v"] @ block["v"].T
        kth = min(k, sims.shape[1])
        # ties with the k-th come along, and what rounding makes a tie
        least = np.partition(sims, -kth, axis=1)[:, -kth] - SLACK
        q, r = np.nonzero(sims >= np.maximum(least, some["least"])[:, None])
        return pa.RecordBatch.from_arrays([pa.array(some["id"][q]), pa.array(block["id"][r]), pa.array(sims[q, r])], ["query_id", "id", "similarity"])

    return compare


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """query_id, rank, id and similarity (cosine) of the k rows of corpus nearest to each query.

    All queries visit the FIRST parts by their bounds, then those others that may hold one of the k best.
    Vectors without length have no neighbours; ties go to the smaller id; a query finds itself if it is in
    the corpus; equal rows of one id each count."""
    rows, lists = index(unit_rows(corpus, id_col, vector_col), block)
    depth = _depth(lists.rows, block or BLOCK)
    rows = rows.withColumn("part", F.shiftright("path", DEPTH - depth)).drop("path")
    asked = cut(unit_rows(queries, id_col, vector_col).withColumn("least", F.lit(-2.0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)

    def first(_: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
        return bounds >= -np.partition(-bounds, FIRST - 1, axis=1)[:, FIRST - 1 : FIRST] if bounds.shape[1] > FIRST else np.ones(bounds.shape, dtype=bool)

    def others(some: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
        return ~first(some, bounds) & (bounds >= some.column("least").to_numpy()[:, None])

    found = ranked(_met(rows, _visiting(asked, lists, first, depth), ["part"], _best(k), _FOUND, block))
    if len(lists.parts(depth)[0]) > FIRST:
        found = cut(found)
        full = found.groupBy(F.col("query_id").alias("id")).agg(F.min("similarity").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
        least = F.coalesce(F.col("kth") - SLACK, F.lit(-2.0))
        again = asked.drop("least").join(full, "id", "left").select("id", "v", least.alias("least"))
        more = _met(rows, _visiting(again, lists, others, depth), ["part"], _best(k), _FOUND, block)
        found = ranked(found.drop("rank").unionByName(more))
    return found.select("query_id", "rank", "id", "similarity")


def nearest_in_band(vectors: DataFrame, theta: float, days: int, earlier: bool, id_col: str = "id", vector_col: str = "embedding", time_col: str = "published_at", block: int | None = None) -> DataFrame:
    """id, other, similarity: of each row that has one, the most similar row above theta that was published up to some days
    earlier (or later, if not earlier; at one time the smaller id is the earlier), ties to the smaller id.

    Rows are kept by days of that width; a row visits its own width and the one before (or after), and brings back
    its best of each block. Of a width with more than a block of rows it visits the parts within its reach."""
    width, half = days * 86_400_000_000, (block or BLOCK) / 2
    timed = vectors.where(F.col(time_col).isNotNull())
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    # a row for each block's rows or more
    halvings = F.least(F.lit(DEPTH), F.floor(F.log2(F.count("*") / half))).cast("int")
    large = cut(timed.groupBy(F.floor(t / width).alias("band")).agg(halvings.alias("depth")).where("depth > 0"))
    rows = unit_rows(timed, id_col, vector_col, t.alias("t"))
    band = F.floor(F.col("t") / width)
    visited = [band + d for d in ((0, -1) if earlier else (0, 1))]

    def compare(block: dict, some: dict) -> pa.RecordBatch | None:
        sims = some["v"] @ block["v"].T
        apart = some["t"][:, None] - block["t"] if earlier else block["t"] - some["t"][:, None]
        at_once = some["id"][:, None] > block["id"] if earlier else some["id"][:, None] < block["id"]
        sims[~((apart <= width) & ((apart > 0) | ((apart == 0) & at_once))) | (sims <= theta)] = -2
        best = np.round(sims, 9).argmax(axis=1)  # the block is in order of ids
        rows = np.arange(len(best))
        some_best = sims[rows, best]
        found = np.flatnonzero(some_best > -2)
        return pa.RecordBatch.from_arrays([pa.array(some["id"][found]), pa.array(block["id"][best[found]]), pa.array(some_best[found])], ["id", "other", "similarity"]) if len(found) else None

    schema = "id bigint, other bigint, similarity double"
    if not large.head(1):
        meets = F.array(F.struct(F.lit(False).alias("comes"), band.alias("band")), *(F.struct(F.lit(True).alias("comes"), b.alias("band")) for b in visited))
        met = _compared(rows.withColumn("meets", F.explode(meets)).select("id", "v", "t", "meets.*"), ["band"], compare, schema)
    else:
        rows, lists = index(rows, block)
        large, depth = F.broadcast(large), F.coalesce("depth", F.lit(0)).alias("depth")
        own = rows.withColumn("band", band).join(large, "band", "left").select("id", "v", "t", "band", "path", depth).withColumn("part", F.expr(f"shiftright(path, {DEPTH} - depth)")).drop("path", "depth")
        asked = rows.select("id", "v", "t", F.explode(F.array(*visited)).alias("band")).join(large, "band", "left").select("id", "v", "t", "band", depth)
        met = _met(own, _visiting(asked, lists, lambda _, bounds: bounds > theta, None).drop("depth"), ["band", "part"], compare, schema, block)
    best = F.max_by(F.struct("other", "similarity"), F.struct(F.round("similarity", 9), -F.col("other")))
    return met.groupBy("id").agg(best.alias("best")).select("id", "best.other", "best.similarity")
