"""Mixing sources to target weights (operator 5).

Documents are summed by membership pattern (the set of sources that a document
belongs to), a min-cost flow routes the patterns' words to the sources' quotas (a second
use of a word costs more than the first), and seeded documents are taken until each
pattern has given its words.  Patterns and sources are tables: the sources' shared level
is found by sums alone, the flow is solved for each connected group of overlapping
sources by itself (a source that overlaps with none is a group of one), in the tasks; a
task holds the patterns of a group, not its documents.  Documents are chosen by joins and
windows over one of 4,096 slices of a pattern.

Edge cases: a null text or one without words has size 0 and nothing is taken of
it; a null source is a source of its own, last in order; documents with equal
ids, or none, share their place in the seeded order unless further columns tell them apart;
equal rows are taken in any order, as they are the same; texts are sized whole; an empty
table gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, is_empty, join_of_keys, row_key, shuffles_end
from tidemark.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Rows key, name, size, target: words wanted of each source (key, name, size).  Sources by
    code point (null last) take the weights in turn and share `share` of all words; none gets
    over cap times its size.

    Ranks come from a range partitioning and the counts of its parts.  A source is over its
    cap just if the level, the words for a weight of one, is; what the others share rises
    with each round, until no further source is over.
    """
    order = (F.col("name").isNull(), F.col("name"))
    dealt = cut(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row for each part
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("start")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(dealt.join(F.broadcast(starts), "part").select("key", "name", "size", weight.alias("weight")))
    discard(dealt)

    def sums(level: float) -> tuple[int, float, float]:
        over = F.col("weight") * F.lit(level) > F.col("size") * F.lit(cap)
        with shuffles_end(sizes.sparkSession):
            r = weighed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size") * F.lit(cap))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.sum("size").alias("size")).first()
        return r.n, share * float(r.size or 0) - float(r.held or 0), float(r.weight or 0)

    level, held = 0.0, -1
    while True:
        n, rest, total = sums(level)
        if n == held or total == 0:
            break
        held, level = n, rest / total
    if total == 0:  # all are full
        target = F.col("size") * F.lit(float(cap))
    else:
        target = F.least(F.lit(rest) * F.col("weight") / F.lit(total), F.col("size") * F.lit(float(cap)))
    return weighed.select("key", "name", "size", target.cast("double").alias("target"))


def min_cost_flow(patterns: dict[str, tuple[tuple, int]], quotas: dict, cap: int) -> dict[str, int]:
    """Words that each pattern gives.  patterns: its sources and its words; each of its
    words can be used cap times, the n-th time at a cost of n - 1.

    Shortest paths to sources with room are taken cost by cost: all first uses, then
    second ones, and so on, in blocking flows of shortest augmenting paths.  Words already
    given may change their source, but are not taken back, so costs stay least.
    """
    keys, names = list(patterns), list(quotas)
    sink = 1 + len(keys) + len(names)
    at = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def link(a: int, b: int, most: int) -> None:
        for x, y, r in ((a, b, most), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)

    for k, key in enumerate(keys):
        link(0, 1 + k, 0)  # opened use by use
        for s in patterns[key][0]:
            if quotas.get(s):
                link(1 + k, at[s], patterns[key][1] * cap)
    for s in names:
        link(at[s], sink, quotas[s])
    opening = {key: next(e for e in out[1 + k] if to[e] == 0) ^ 1 for k, key in enumerate(keys)}
    for _ in range(cap):
        for key in keys:
            room[opening[key]] += patterns[key][1]
        while True:
            depth = [-1] * (sink + 1)
            depth[0], layer = 0, [0]
            while layer and depth[sink] < 0:
                following = []
                for a in layer:
                    for e in out[a]:
                        if room[e] and depth[to[e]] < 0:
                            depth[to[e]] = depth[a] + 1
                            following.append(to[e])
                layer = following
            if depth[sink] < 0:
                break
            tried, path, a = [0] * (sink + 1), [], 0
            while True:
                if a == sink:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    back = next(i for i, e in enumerate(path) if not room[e])
                    a = to[path[back] ^ 1]
                    del path[back:]
                elif tried[a] < len(out[a]):
                    e = out[a][tried[a]]
                    if room[e] and depth[to[e]] == depth[a] + 1:
                        path.append(e)
                        a = to[e]
                    else:
                        tried[a] += 1
                elif path:
                    e = path.pop()
                    a = to[e ^ 1]
                    tried[a] += 1
                else:
                    break
    return {key: room[opening[key] ^ 1] for key in keys}


def pattern_key(sources: Column) -> Column:
    """A string for a set of sources, nulls among them."""
    return F.array_join(F.array_sort(F.transform(F.array_distinct(sources), _source_key)), ",")


def _solve(cap: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        """pattern and given of a group's rows (pattern, words, key, quota), by the flow."""
        rows = rows.sort_values(["pattern", "key"])
        patterns = {p: (tuple(own["key"]), int(own["words"].iloc[0])) for p, own in rows.groupby("pattern", sort=False)}
        quotas = {k: int(q) for k, q in zip(rows["key"], rows["quota"], strict=True)}
        given = min_cost_flow(patterns, quotas, cap)
        return pd.DataFrame({"pattern": list(given), "given": list(given.values())})

    return solve


def _source_key(name: Column) -> Column:
    return F.coalesce(F.hex(name), F.lit("-"))


def given_words(patterns: DataFrame, weights: Sequence[float], share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """pattern, given, source_size and target (of its first source) of each of patterns (pattern,
    words, sources); and the table of sources."""
    members = cut(patterns.select("pattern", "words", F.posexplode(F.array_distinct("sources")).alias("place", "name")).withColumn("key", _source_key(F.col("name"))))
    sizes = members.groupBy("key").agg(F.first("name").alias("name"), F.sum("words").alias("size"))
    targets = cut(source_targets(cut(sizes), weights, share, cap))
    wanted = members.join(targets.select("key", "size", "target"), "key").withColumn("node", F.xxhash64("key")).withColumn("quota", F.rint("target").cast("long"))
    several = members.where("place > 0").select("pattern").distinct()
    if is_empty(several):
        grouped = wanted.withColumn("group", F.col("node"))
    else:
        nodes = members.join(several, "pattern").groupBy("pattern").agg(F.array_sort(F.collect_set(F.xxhash64("key"))).alias("nodes"))
        edges = nodes.select(F.col("nodes")[0].alias("b"), F.explode("nodes").alias("a"))
        grouped = wanted.join(components(edges), "node", "left").withColumn("group", F.coalesce("root", "node"))
    given = grouped.select("group", "pattern", "words", "key", "quota").groupBy("group").applyInPandas(_solve(cap), "pattern string, given long")
    first = wanted.where("place = 0").select("pattern", F.col("size").alias("source_size"), "target")
    return patterns.join(given, "pattern", "left").join(first, "pattern", "left").withColumn("given", F.coalesce("given", F.lit(0))), targets


def mix(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 7, whole: bool = False, row: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix of sized (doc_id, size, sources array<string>), and the table of the sources.

    Each word of a document counts for all its sources.  whole: documents are taken
    whole, so a pattern's sum may miss its share by half a document; otherwise one
    document of each pattern is cut to meet it.  row: further columns of sized that tell rows
    apart; they order rows without an id or with equal ids.  Returns doc_id, size, sources and
    taken (words, repeats counted), source_size and target of the first source, the columns of
    row; and name, source_size and target of each source.
    """
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    if row:
        order = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), *row)).otherwise(order)
    base = cut(
        sized.select("doc_id", "size", "sources", *row).withColumn("pattern", pattern_key(F.col("sources"))).withColumn("place", order).withColumn("slice", F.shiftrightunsigned(F.col("place"), 64 - SLICE_BITS).cast("int"))
    )
    patterns = cut(base.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("sources").alias("sources")))
    given, targets = given_words(patterns, weights, share, cap)
    some = F.greatest("words", F.lit(1))
    wanted = cut(given.select("pattern", "rows", "source_size", "target", F.expr("given div greatest(words, 1)").alias("passes"), (F.col("given") % some).alias("rest")))
    # the slice of each pattern in which its last, partial pass ends
    by_slice = base.groupBy("pattern", "slice").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("slice")
    ends = (
        by_slice.withColumn("upto", F.sum("words").over(run))
        .join(wanted.select("pattern", "rest"), "pattern")
        .where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        .select("pattern", F.col("slice").alias("end_slice"), (F.col("upto") - F.col("words")).alias("before"))
    )
    plan = cut(wanted.join(ends, "pattern", "left"))  # one row for each pattern
    placed = join_of_keys(base, plan, ["pattern"], "rows")
    inside = F.col("slice") == F.col("end_slice")
    in_order = Window.partitionBy("pattern").orderBy("place", "doc_id", *row, "size")
    last = placed.where(inside).withColumn("sum_before", F.col("before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    left = F.col("rest") - F.col("sum_before")
    if whole:
        share_of = F.when(F.col("size") <= 2 * left, F.col("size")).otherwise(0)
    else:
        share_of = F.greatest(F.lit(0), F.least(F.col("size"), left))
    other = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("slice") < F.col("end_slice"), F.col("size")).otherwise(0))
    out = other.unionByName(last.withColumn("extra", share_of).drop("sum_before"))
    taken = (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    return out.select("doc_id", "size", "sources", *row, taken, "source_size", "target"), targets.select("name", F.col("size").cast("double").alias("source_size"), "target")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k1, _ = row_key()
    mixed, _ = mix(docs.select("doc_id", word_count(F.col("text")).alias("size"), F.array("source").alias("sources"), k1), row=("k1",))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
