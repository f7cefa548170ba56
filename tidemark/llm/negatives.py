"""Hard-negative mining (operator 13): exact inner-product search in inverted lists.

Vectors become whole numbers (llm/vectors.py).  Every row is put into the list of its nearest
of some centroids, and each list keeps the greatest distance of a row from its centroid, its
radius.  By Cauchy-Schwarz the score of anchor q with any row of a list lies within
|q| x radius of q's score with the centroid.  So an anchor visits the lists by falling upper bound, skips
those whose scores all lie outside its window, and stops when the bound falls strictly below its k-th
score so far: what is found is exact whatever the centroids are, ties included.

The centroids are fitted by k-means on a sample of SAMPLE rows or so (by a hash of the row); all rows
are indexed.  Their number is the root of the number of rows, MOST_LISTS at most.

Spark: all anchors visit their first VISITS lists in one round, then four times as many, and so on. In a round
anchors go to the lists that they visit, by shuffle; a list is dealt in blocks of BLOCK rows, so a task holds one block
and streams the anchors past it. With over ANCHORS anchors, blocks are written once more for each further
ANCHORS of them. The best of each anchor are kept by a window over (anchor, window) whose groups are pruned before
they are shuffled. The driver sees centroids and radii only.

Mining: an anchor's positives are its best other rows of the same label, its negatives those rows of
other labels that score within a window below the positive's score.

Edge cases: rows with a null label, or a null vector or one that holds null or non-finite components, take no
part; rows without an id are never anchors, come last among ties and have a null id in the result (ids are below 2^63 - 1);
repeated rows are rows, each an anchor and another row's positive or negative; shorter vectors count as
followed by zeros; fewer rows than asked for are all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, boundaries, cut, discard, is_empty, named, shuffles_end
from tidemark.llm.vectors import matrix, whole_numbers

SAMPLE, MOST_LISTS, FIT_ROUNDS, SEED = 16_384, 1024, 4, 42
VISITS, BLOCK, ANCHORS, TILE = 16, 2048, 65_536, 128
POSITIVES, NEGATIVES = 5, 3
#: Stands for a null id: it sorts behind all others.
NO_ID = (1 << 63) - 1
_LEAST, _MOST = -(1 << 62), 1 << 62
_FOUND = "anchor bigint, slot int, score bigint, vec_id bigint, row bigint"


def indexed(rows: DataFrame, length: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rows (row, vec_id, label, v) in lists and blocks, the centroids, and each list's radius and number of blocks."""
    spark = rows.sparkSession
    with shuffles_end(spark):
        n = rows.count()
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 32)) < F.lit(int((1 << 32) * min(1.0, SAMPLE / n)) + 1)
    sample = rows.where(share).select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=max(2, min(isqrt(n), MOST_LISTS)), maxIter=FIT_ROUNDS, initSteps=1, seed=SEED).fit(sample)
    centroids = np.array(model.clusterCenters(), dtype=np.float64)
    half = (centroids**2).sum(axis=1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), length, np.float64)
            own = (v @ centroids.T - half).argmax(axis=1)  # any list is right: radii are of what it holds
            far = np.sqrt(((v - centroids[own]) ** 2).sum(axis=1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], [*batch.schema.names, "list", "far"])

    kept = cut(arrow_map(rows, assign, "row bigint, vec_id bigint, label bigint, v array<int>, list int, far double"))
    radius, blocks = np.zeros(len(centroids)), np.ones(len(centroids), dtype=np.int64)
    with shuffles_end(spark):
        for r in kept.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect():
            radius[r.list], blocks[r.list] = r.radius, -(-r.n // BLOCK)
    return kept, centroids, radius, blocks


def _visits(anchors: DataFrame, length: int, centroids: np.ndarray, radius: np.ndarray, blocks: np.ndarray, first: int, last: int, shares: int) -> DataFrame:
    """Each anchor once for each block of those of its lists first to last that it still has to visit."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                v = matrix(some.column("v"), length, np.float64)
                norm = np.sqrt((v**2).sum(axis=1))
                middle, reach = v @ centroids.T, norm[:, None] * radius
                slack = 1e-9 * (norm[:, None] * (np.sqrt((centroids**2).sum(axis=1)) + radius)) + 1e-3
                above, below = middle + reach + slack, middle - reach - slack
                turn = np.argsort(-above, axis=1, kind="stable")[:, first:last]
                above, below = np.take_along_axis(above, turn, 1), np.take_along_axis(below, turn, 1)
                wanted = np.zeros(turn.shape, dtype=bool)
                low, high = some.column("low"), some.column("high")
                slots = np.diff(low.offsets.to_numpy())
                who, low, high = np.repeat(np.arange(some.num_rows), slots), low.flatten().to_numpy(), high.flatten().to_numpy()
                for k in range(int(slots.max(initial=0))):
                    own = np.flatnonzero(slots > k)
                    window = np.searchsorted(who, own) + k
                    wanted[own] |= (above[own] >= low[window, None]) & (below[own] <= high[window, None])
                i, j = np.nonzero(wanted)
                lists = turn[i, j]
                i, lists = np.repeat(i, blocks[lists]), np.repeat(lists, blocks[lists])
                block = _within(i, lists)
                out = some.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(block.astype(np.int32)), *(out.column(c) for c in ("row", "label", "v", "low", "high"))], ["list", "block", "row", "label", "v", "low", "high"])

    found = arrow_map(anchors.select("row", "label", "v", "low", "high"), choose, "list int, block int, row bigint, label bigint, v array<int>, low array<bigint>, high array<bigint>")
    return found.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int"))


def _within(*keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys."""
    starts = boundaries(list(keys))
    lengths = np.diff(np.append(starts, len(keys[0])))
    return np.arange(len(keys[0])) - np.repeat(starts, lengths)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of each row, ties to the first column."""
    held = np.where(allowed, scores, _LEAST * 2)
    rows, cols = [], []
    every = np.arange(len(held))
    for _ in range(min(k, held.shape[1])):
        at = held.argmax(axis=1)
        real = held[every, at] > _LEAST * 2
        if not real.any():
            break
        rows.append(every[real])
        cols.append(at[real])
        held[every, at] = _LEAST * 2
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where all sums are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _meet(lists: DataFrame, visits: DataFrame, blocks: np.ndarray, length: int, shares: int, same: bool, k: int) -> DataFrame:
    """The best rows of each block for each window of the anchors that visit it."""
    n_blocks = F.element_at(F.lit(blocks.astype(int).tolist()), F.col("list") + 1)
    side = lists.withColumn("block", F.pmod(F.xxhash64("row"), n_blocks).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    none = F.lit(None).cast("array<bigint>")
    names = ["list", "block", "share", "comes", "row", "vec_id", "label", "v", "low", "high"]
    both = side.select("list", "block", "share", F.lit(False).alias("comes"), "row", "vec_id", "label", "v", none.alias("low"), none.alias("high")).unionByName(visits.select("list", "block", "share", F.lit(True).alias("comes"), "row", F.lit(0).cast("bigint").alias("vec_id"), "label", "v", "low", "high"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "block", "share", "comes")]
            starts = boundaries(keys)
            for first, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                run = batch.slice(first, end - first)
                own, comes = tuple(int(x[first]) for x in keys[:3]), bool(keys[3][first])
                if own != key:
                    key, held = own, []
                cols = [run.column(c).to_numpy() for c in ("row", "vec_id", "label")] + [matrix(run.column("v"), length)]
                if not comes:
                    held.append(tuple(cols))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    yield from _against(held[0], run, cols, same, k)

    met = both.select(*names).repartition("list", "block", "share").sortWithinPartitions("list", "block", "share", "comes", "vec_id", "row")
    return arrow_map(met, search, _FOUND)


def _against(block: tuple[np.ndarray, ...], run: pa.RecordBatch, anchors: list[np.ndarray], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """block: rows, ids, labels and vectors, by (id, row)."""
    rows, ids, labels, vectors = block
    for first in range(0, run.num_rows, TILE):
        some = run.slice(first, TILE)
        row, _, label, v = (x[first : first + TILE] for x in anchors)
        scores = products(v, vectors)
        fits = (label[:, None] == labels) == same
        fits &= row[:, None] != rows
        slots = np.diff(some.column("low").offsets.to_numpy())
        start = np.cumsum(slots) - slots
        low, high = (some.column(c).flatten().to_numpy() for c in ("low", "high"))
        for slot in range(int(slots.max(initial=0))):
            own = np.flatnonzero(slots > slot)
            at = start[own] + slot
            within = fits[own] & (scores[own] >= low[at, None]) & (scores[own] <= high[at, None])
            i, j = best_of(scores[own], within, k)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(row[own[i]]), pa.array(np.full(len(i), slot, np.int32)), pa.array(scores[own[i], j]), pa.array(ids[j]), pa.array(rows[j])], ["anchor", "slot", "score", "vec_id", "row"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(lists: DataFrame, anchors: DataFrame, centroids: np.ndarray, radius: np.ndarray, blocks: np.ndarray, length: int, same: bool, k: int) -> DataFrame:
    """anchor, slot, score, vec_id, row, rank: for each anchor (row, label, v, low, high: a window of scores in each slot) and
    window the k best rows of the same label, or of other ones.  anchors must be a table that cut() wrote; so is the result."""
    with shuffles_end(anchors.sparkSession):
        shares = -(-anchors.count() // ANCHORS) or 1
    found, first, step = None, 0, VISITS
    while first < len(centroids):
        now = anchors
        if found is not None:  # a full window begins at its k-th score
            full = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            kth = full.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
            risen = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
            now = anchors.join(kth, "row", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(risen)).drop("kth")
        visits = cut(_visits(now, length, centroids, radius, blocks, first, first + step, shares))
        if is_empty(visits):  # later lists may still lie in a window that these are above
            discard(visits)
            first, step = first + step, step * 4
            continue
        new = _meet(lists, visits, blocks, length, shares, same, k)
        both = cut(_ranked(new if found is None else found.drop("rank").unionByName(new), k))
        discard(visits, *([] if found is None else [found]))
        found, first, step = both, first + step, step * 4
    return cut(anchors.sparkSession.createDataFrame([], _FOUND + ", rank int")) if found is None else found


def mine(vectors: DataFrame, is_anchor, low, high, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on column vec_id; low and high: the least and the greatest score of a
    negative, as functions of the positive's score."""
    label = named(label_col)
    rows, length = whole_numbers(vectors.where(label.isNotNull()).select(named(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), named(vector_col).alias("vector")), "vector")
    numbered = cut(rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", "v"))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if is_empty(numbered):
        discard(numbered)
        return vectors.sparkSession.createDataFrame([], schema)
    lists, *index = indexed(numbered, length)
    discard(numbered)
    one = lambda x: F.array(F.lit(x).cast("bigint"))
    anchors = cut(lists.where(is_anchor & (F.col("vec_id") != NO_ID)).select("row", "vec_id", "label", "v", one(_LEAST).alias("low"), one(_MOST).alias("high")))
    good = search(lists, anchors, *index, length, same=True, k=positives)
    by_anchor = good.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("good"))
    windows = {"low": F.transform("good", lambda g: low(g["score"])), "high": F.transform("good", lambda g: high(g["score"]))}
    asking = cut(anchors.drop("low", "high").join(by_anchor, "row").withColumns(windows).drop("good"))
    bad = search(lists, asking, *index, length, same=False, k=negatives)
    discard(lists, asking)
    pairs = good.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(bad.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"])
    out = out.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    known = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def _over_100(x: Column) -> Column:
    """Whole hundreds of a number of 0 or more, exact beyond what a double holds."""
    return ((x - x % 100).cast("decimal(20,0)") / 100).cast("bigint")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # 50 p <= 100 n <= 95 p, for whole n; no n meets this where p is negative
    low = lambda p: F.when(p < 0, F.lit(1)).otherwise(F.shiftright(p + 1, 1)).cast("bigint")
    high = lambda p: F.when(p < 0, F.lit(0)).otherwise(_over_100(95 * p)).cast("bigint")
    return mine(rows.select("vec_id", "embedding", turned.alias("label")), F.col("vec_id") % 50 == 0, low, high)
