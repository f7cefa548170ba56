"""Exact comparison of sets in groups: who is similar to whom, block pair by block pair.

A group of candidates is dealt in blocks, each two of which meet in one task: a member is
written once for each block of its group, so the copies of a group of G members grow with
G to the power of 1.5 at first and, beyond what one task shall hold, with its square over
MOST.  Inside a task sets are compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sets and elements that a task holds at most, about; a group is spread in pieces of SPREAD.
MOST, MOST_ELEMENTS, SPREAD = 1 << 14, 1 << 21, 100
TILE = 512
_WIDTH = 4096


def block_count(sets: Column, elements: Column | None = None, most: int = MOST) -> Column:
    """In how many blocks a group of so many sets, of so many elements in all, is dealt."""
    wanted = [F.sqrt(sets / F.lit(min(SPREAD, most))), sets * 2 / most]
    if elements is not None:
        wanted.append(elements * 2 / F.lit(MOST_ELEMENTS))
    return F.ceil(F.greatest(F.lit(1.0), *(w.cast("double") for w in wanted))).cast("int")


def in_block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Each row (with a column blocks) once for each pair of blocks that its own is in: b1, b2, block."""
    own = rows.withColumn("block", F.pmod(F.xxhash64(key), "blocks").cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")}).drop("blocks", "other")


def _incidence(ids: np.ndarray, rows: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(columns)), dtype=np.float32)
    at = np.searchsorted(columns, ids)
    inside = at < len(columns)
    inside[inside] = columns[at[inside]] == ids[inside]
    out[rows[inside], at[inside]] = 1
    return out


def similar_pairs(sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, each pair once, of sets with a Jaccard similarity of num / den or more.
    sets: arrays of distinct elements; the pairs come tile by tile."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")  # tiles of like sizes: far ones are skipped
    _, ids, often = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), n[order])
    ids, rows = ids[often[ids] > 1], rows[often[ids] > 1]
    bounds = np.searchsorted(rows, np.arange(0, len(sets) + TILE, TILE))
    size = n[order]

    def tile(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return ids[bounds[t] : bounds[t + 1]], rows[bounds[t] : bounds[t + 1]] - t * TILE, size[t * TILE : (t + 1) * TILE]

    tiles = -(-len(sets) // TILE)
    for a in range(tiles):
        ids_a, rows_a, size_a = tile(a)
        for b in range(a, tiles):
            ids_b, rows_b, size_b = tile(b)
            if den * size_a[-1] < num * size_b[0]:
                break  # sets further on are larger still
            common = np.intersect1d(ids_a, ids_b) if a != b else np.unique(ids_a)
            shared = np.zeros((len(size_a), len(size_b)), dtype=np.float32)
            for first in range(0, len(common), _WIDTH):
                columns = common[first : first + _WIDTH]
                left = _incidence(ids_a, rows_a, len(size_a), columns)
                shared += left @ (left if a == b else _incidence(ids_b, rows_b, len(size_b), columns)).T
            near = shared.astype(np.int64) * (num + den) >= num * (size_a[:, None] + size_b[None, :])
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            if len(i):
                yield order[a * TILE + i], order[b * TILE + j]
