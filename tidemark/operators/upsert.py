"""Writes by key without MERGE: the table that results from a batch, as a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old and those rows of new whose key isn't there; of equal keys in new the first by order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    once = new.withColumn("upsert_rank", first).where("upsert_rank = 1").drop("upsert_rank")
    return old.unionByName(once.join(old.select(*keys), list(keys), "left_anti"))


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """What inserting new row by row, in a total order, adds to a table with several unique keys:
    a row that collides in any key with old, or with a row added before it, is left out; a
    null key collides with nothing.

    In each round the rows that come first under all their keys are added and those that
    collide with them go; a row that was only behind one that went has its turn in the next
    round.  There are as many rounds as such rows follow from each other, mostly one or two.
    """

    def without(rows: DataFrame, others: DataFrame) -> DataFrame:
        for k in keys:
            rows = rows.join(others.select(k), k, "left_anti")
        return rows.select(*new.columns)

    places = {f"upsert_rank_{k}": F.when(F.col(k).isNotNull(), F.row_number().over(Window.partitionBy(k).orderBy(*order))) for k in keys}
    added, rest = None, cut(without(new, old))
    while True:
        first = rest.withColumns(places).where(" and ".join(f"coalesce(`{c}`, 1) = 1" for c in places)).select(*new.columns)
        added = first if added is None else added.unionByName(first)
        # of the others, those without a first row's key
        behind = rest.withColumns(places).where(" or ".join(f"`{c}` > 1" for c in places)).select(*new.columns)
        rest = cut(without(behind, first))
        if not rest.take(1):
            return added


def replace(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """new's rows, and old's of other keys.  Of rows of new with one key the first by order
    stays; without an order new must have each key once."""
    if order is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        new = new.withColumn("upsert_rank", place).where("upsert_rank = 1").drop("upsert_rank")
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def keep_first(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """new's rows, and old's of other keys; where a key was there already, the columns kept stay as they were."""
    before = old.select(*keys, *(F.col(c).alias(f"old {c}") for c in kept))
    joined = new.join(before, list(keys), "left")
    rows = joined.select(*(F.coalesce(f"old {c}", c).alias(c) if c in kept else F.col(c) for c in old.columns))
    return rows.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def confirm(old: DataFrame, news: DataFrame, keys: Sequence[str], source: str, weaker: str) -> DataFrame:
    """Events that a better source confirms: old rows of the weaker source that aren't confirmed
    yet become the source's, with a note; all others stay; news without an old row are added.
    Both have the columns keys, title, confidence, source and notes."""
    known = news.select(*keys).distinct().withColumn("upsert_known", F.lit(True))
    joined = old.join(known, list(keys), "left")
    better = F.col("upsert_known").isNotNull() & (F.col("source") == weaker) & ~F.col("confidence").eqNullSafe("confirmed")
    note = F.concat(F.lit("Upgraded from "), F.col("source"), F.lit(f" to {source} confirmed"))
    changed = joined.withColumns({"notes": F.when(better, note).otherwise(F.col("notes")), "confidence": F.when(better, "confirmed").otherwise(F.col("confidence")), "source": F.when(better, source).otherwise(F.col("source"))})
    fresh = news.withColumns({"confidence": F.lit("confirmed"), "source": F.lit(source)}).join(old.select(*keys), list(keys), "left_anti")
    return changed.select(*old.columns).unionByName(fresh.select(*old.columns))


def coalesce_update(old: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the columns of delta where delta has a value for them."""
    columns = [c for c in delta.columns if c not in keys]
    changed = delta.select(*keys, *(F.col(c).alias(f"delta_{c}") for c in columns))
    joined = old.join(changed, list(keys), "left")
    return joined.select(*(F.coalesce(f"delta_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def precedence(old: DataFrame, new: DataFrame, keys: Sequence[str], source: str, ranks: dict[str, int], fill: Sequence[str]) -> DataFrame:
    """Full outer upsert: a row of a lower-ranked source doesn't replace one of a higher, but
    fills its missing columns `fill`."""

    def rank(c: Column) -> Column:
        out = F.lit(0)
        for name, r in ranks.items():
            out = F.when(c == name, r).otherwise(out)
        return out

    a = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("o"))
    b = new.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("n"))
    joined = a.join(b, list(keys), "full")
    keep = F.col("n").isNull() | (F.col("o").isNotNull() & (rank(F.col(f"o.{source}")) > rank(F.col(f"n.{source}"))))

    def merged(c: str) -> Column:
        mine, other = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(keep, F.coalesce(mine, other) if c in fill else mine).otherwise(F.coalesce(other, mine) if c in fill else other).alias(c)

    return joined.select(*keys, *(merged(c) for c in old.columns if c not in keys))


def latest_active(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """is_active for the newest row of each key; the others were deactivated by it."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("is_active", place == 1)


def delete_where(rows: DataFrame, *conditions: Column) -> DataFrame:
    """rows without those that meet any condition; an unknown one does not delete."""
    out = rows
    for c in conditions:
        out = out.where(~F.coalesce(c, F.lit(False)))
    return out
