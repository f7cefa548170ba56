"""Records that come to named entities: matched by the exact name, else by the normalised one, and merged by precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_company


def matched(old: DataFrame, new: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """new with id_col, the entity of each record, and entity, which tells entities apart.

    A record belongs to the old row of its very name (of several the one with the least id), else to
    the least old row with its normalised name; records that match none found an entity for each
    normalised name, or name where that is empty: id_col is null. That is what taking the records one
    by one gives, as no record founds an entity that another already has."""
    known = old.select(id_col, F.col(name_col).alias("old name"), normalize_company(F.col(name_col)).alias("old form"))
    exact = known.groupBy("old name").agg(F.min(id_col).alias("by name"))
    formal = known.where(F.col("old form") != "").groupBy("old form").agg(F.min(id_col).alias("by form"))
    told = new.withColumn("form", normalize_company(F.col(name_col)))
    found = told.join(exact, told[name_col] == exact["old name"], "left").join(formal, told["form"] == formal["old form"], "left")
    target = F.coalesce("by name", "by form")
    own = F.when(target.isNotNull(), F.concat(F.lit("old "), target.cast("string"))).when(F.col("form") != "", F.concat(F.lit("form "), F.col("form"))).otherwise(F.concat(F.lit("name "), F.coalesce(name_col, F.lit(""))))
    return found.select(*new.columns, target.alias(id_col), own.alias("entity"))


def merge_listings(old: DataFrame, new: DataFrame, order: str, id_col: str = "id", name_col: str = "company_name", source: str = "source", best: str = "finnhub", fill: Sequence[str] = ("sector", "valuation")) -> DataFrame:
    """The table that taking new's records one by one, in a total order, makes of old.

    A record overwrites its entity's columns, nulls too, but for its name; a source stays where the
    record has none. An entity of the best source is overwritten by that source's records only; others give it
    their values of fill. So the last record that overwrites decides, and the last values of fill behind it:
    both are aggregates, and an entity with very many records is no more than its sums. New entities have no id."""
    values = [c for c in old.columns if c not in (id_col, name_col, source)]
    record = lambda names: F.struct(*(F.col(c) for c in names))
    is_best = F.coalesce(F.col(source) == best, F.lit(False))
    told = matched(old, new, id_col, name_col)

    def last(what: Column, of: Column) -> Column:
        """The newest record's values among those that meet a condition, with their order."""
        return F.max_by(F.when(of, F.struct(F.col(order).alias("at"), what.alias("x"))), F.when(of, F.col(order)))

    merged = told.groupBy("entity").agg(
        F.first(id_col).alias(id_col),
        F.min_by(name_col, order).alias("first name"),
        last(record(values), is_best).alias("by best"),
        last(record(values), F.lit(True)).alias("by any"),
        last(F.col(source), F.col(source).isNotNull()).alias("told source"),
        *(last(F.col(c), F.col(c).isNotNull()).alias(f"fill {c}") for c in fill),
    )
    before = old.select(F.col(id_col).alias("old id"), F.col(name_col).alias("old name"), F.col(source).alias("old source"), record(values).alias("old values"))
    both = before.join(merged, F.col("old id") == F.col(id_col), "full")
    was_best = F.coalesce(F.col("old source") == best, F.lit(False))
    # what overwrites last: the best source's newest, else (unless the old row is the best source's) the newest of all
    over = F.when(F.col("by best").isNotNull(), F.col("by best")).when(~was_best, F.col("by any"))

    def final(c: str) -> Column:
        kept = F.when(over.isNotNull(), over["x"][c]).otherwise(F.col("old values")[c])
        if c not in fill:
            return kept.alias(c)
        later = F.col(f"fill {c}").isNotNull() & (over.isNull() | (F.col(f"fill {c}")["at"] > over["at"]))
        return F.when(later, F.col(f"fill {c}")["x"]).otherwise(kept).alias(c)

    # a source is told with what overwrites: other records than the best source's don't change it once it is that
    any_best = was_best | F.col("by best").isNotNull()
    its_source = F.when(any_best, F.lit(best)).otherwise(F.coalesce(F.col("told source")["x"], F.col("old source")))
    columns = {id_col: F.col("old id").alias(id_col), name_col: F.coalesce("old name", "first name").alias(name_col), source: its_source.alias(source)}
    return both.select(*(columns[c] if c in columns else final(c) for c in old.columns))
