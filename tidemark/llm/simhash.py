"""SimHash near-duplicates (operator 3) by bit-sliced comparison.

Equal fingerprints are first made one.  Two fingerprints within the radius r agree
on one of r + 1 blocks of their bits at least, so distinct fingerprints are dealt
by (block, its bits); inside such a bucket distances are counted bit-sliced: bit
plane b of 64 fingerprints is one word, one XOR gives 64 lanes of difference, and
carry-save counters add them, until all lanes exceed the radius.

A bucket over a limit is dealt again by blocks of the bits that it doesn't share,
as often as needed: every step leaves three quarters of the free bits, so a
bucket's size has an end whatever the data are, no link is lost, and no task holds
more than the limit.  A bucket yields the edges of a spanning forest, not its
pairs; components come from star contraction.

Edge cases: a null text, an empty one and one without words have fingerprint zero
and link like any other; under three words the whole sequence is the one shingle;
texts are taken whole; repeated rows share a fingerprint; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, boundaries, cut, discard, join_of_keys, runs
from tidemark.llm.components import components
from tidemark.llm.kernels import mix64

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that are compared with each other in one bucket at most.
LIMIT = 2048
#: Fingerprints whose distances are counted together.
TILE = 256
_LANE = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes) -> list[int]:
    """XXH64 of the 3-word shingles of a text, repeats included."""
    words = raw.lower().split()  # on bytes: lowers A-Z and splits at 0x20, 0x09-0x0D only
    n = len(words)
    if n == 0:
        return []
    joined = b" ".join(words)
    if n <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of counts[i] hashes: bits set in over half of them.

    Bits are counted eight at a time in the bytes of 64-bit words, 255 hashes to a
    block, so that no byte overflows.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    own = counts[rows]
    blocks = -(-own // 255)
    first_row = np.cumsum(own) - own
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first_block, blocks)
    at = np.repeat(first_row, blocks) + 255 * within
    for b in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & _LANE, at)
        lanes = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        for k in range(8):
            out[rows] |= (2 * lanes[:, k] > own).astype(np.uint64) << np.uint64(8 * k + b)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"")
            found = []
            for first in range(0, len(texts), 256):
                hashes, counts = [], []
                for t in texts[first : first + 256].to_pylist():
                    own = shingle_hashes(t)
                    hashes.append(np.array(own, dtype=np.uint64))
                    counts.append(len(own))
                found.append(majority_bits(np.concatenate(hashes), np.array(counts, dtype=np.int64)))
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, fp bigint")


def _block_masks(mask: int, blocks: int) -> list[int]:
    """The set bits of a mask in blocks of nearly equal size."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, dtype=int), blocks)]


def _deal(radius: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint once for each block of its free bits: fp, free, key."""
        for batch in batches:
            fp, free, key = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("fp", "free", "key"))
            parts = []
            for mask in np.unique(free):
                on = free == mask
                for b, block in enumerate(_block_masks(int(mask), radius + 1)):
                    if block == 0:
                        continue  # no free bits are left for it: the bucket is small by then
                    into = mix64(key[on] ^ mix64(np.full(int(on.sum()), b + 1, np.uint64) + mask)) ^ mix64(fp[on] & np.uint64(block))
                    parts.append((fp[on], np.full(int(on.sum()), int(mask) & ~block, np.uint64), mix64(into)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*parts, strict=True)], ["fp", "free", "key"])

    return deal


def close_pairs(fps: np.ndarray, run_ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j < run_ends[i], of fingerprints within the radius.

    fps: fingerprints in runs; run_ends[i]: where the run of i ends.
    """
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, dtype=np.uint64)
    padded[:n] = fps
    octets = padded.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(octets, axis=1, bitorder="little")  # [n, 64]
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)  # [64, words]
    stages = max(int(radius).bit_length(), 1)  # counters up to 2**stages - 1; more sticks in over
    found_i, found_j = [], []
    lane = np.arange(64)
    for first in range(0, n, TILE):
        last = min(first + TILE, n)
        queries = fps[first:last]
        from_word, to_word = first >> 6, -(-int(run_ends[first:last].max()) // 64)
        shape = (last - first, to_word - from_word)
        at = (from_word * 64 + np.arange(shape[1] * 64))[None, :]
        wanted = (at > np.arange(first, last)[:, None]) & (at < run_ends[first:last, None])
        if not wanted.any():
            continue
        alive = np.packbits(wanted, axis=1, bitorder="little").view(np.uint64)
        over = ~alive
        counters = [np.zeros(shape, dtype=np.uint64) for _ in range(stages)]
        for b in range(64):
            query = np.where((queries >> np.uint64(b)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            carry = planes[b, from_word:to_word][None, :] ^ query[:, None]
            for c in counters:  # carry-save addition of one bit to 64 counters in each word
                carry_on = c & carry
                np.bitwise_xor(c, carry, out=c)
                carry = carry_on
            np.bitwise_or(over, carry, out=over)
            if b % 8 == 7 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break  # all lanes exceed the radius
        else:
            near = ~over
            for limit_bit in range(radius + 1, 1 << stages):  # counts between the radius and what the counters hold
                equal = near.copy()
                for s, c in enumerate(counters):
                    equal &= c if limit_bit >> s & 1 else ~c
                near &= ~equal
            rows, words = np.nonzero(near)
            if len(rows):
                hit = (near[rows, words][:, None] >> lane.astype(np.uint64)[None, :]) & np.uint64(1)
                which, k = np.nonzero(hit)
                found_i.append(rows[which] + first)
                found_j.append((from_word + words[which]) * 64 + k)
    if not found_i:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of the component of each of n nodes."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _compare(radius: int, limit: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b) of a spanning forest of each bucket; of a bucket over the limit, its
        members (a), its free bits and its key, to be dealt again."""
        for table, over in runs(batches, ["key"], limit):
            fp = table.column("fp").to_numpy().view(np.uint64)
            if over:
                n = len(fp)
                columns = [pa.array(fp.view(np.int64)), pa.nulls(n, pa.int64()), table.column("free").combine_chunks(), table.column("key").combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "free", "key"])
                continue
            starts = boundaries([table.column("key").to_numpy()])
            sizes = np.diff(np.append(starts, len(fp)))
            many = np.repeat(sizes > 1, sizes)
            fp, sizes = fp[many], sizes[sizes > 1]
            ends = np.repeat(np.cumsum(sizes), sizes)
            # runs of a table are compared some at a time: pairs found stay bounded
            cuts = np.flatnonzero(np.diff(ends // (4 * limit), prepend=-1)) if len(ends) else []
            for first, last in zip(cuts, [*cuts[1:], len(fp)], strict=False):
                own = fp[first:last]
                i, j = close_pairs(own, ends[first:last] - first, radius)
                root = forest(len(own), i, j)
                child = np.flatnonzero(root != np.arange(len(own)))
                if len(child):
                    a, b = own[child].view(np.int64), own[root[child]].view(np.int64)
                    none = pa.nulls(len(child), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "free", "key"])

    return compare


def near_edges(distinct: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect just those that
    links of at most radius bits connect."""
    open_ = distinct.select("fp", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("key"))
    edges = None
    for _ in range(64):
        dealt = arrow_map(open_, _deal(radius), "fp bigint, free bigint, key bigint")
        bucketed = dealt.repartition("key").sortWithinPartitions("key", "fp")
        out = cut(arrow_map(bucketed, _compare(radius, limit), "a bigint, b bigint, free bigint, key bigint"))
        found = out.where("b is not null").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        open_ = out.where("b is null").select(F.col("a").alias("fp"), "free", "key")
        if open_.limit(1).count() == 0:
            return edges
    raise RuntimeError("buckets did not shrink")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach."""
    own = cut(fingerprints(docs, id_col, text_col))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows of it")))
    roots = components(near_edges(classes, radius, limit))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_doc", "rows of it", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_class = cut(rooted.join(least, "root").select("fp", "component_id", "rows of it"))
    discard(classes, roots)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_of_keys(own, of_class, ["fp"], "rows of it").select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
