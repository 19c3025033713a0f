"""Aggregates that depend on the order of a group's rows, as plain aggregations: every order is an explicit column, so
results do not depend on how rows are dealt, and partial aggregation keeps what is shuffled small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_known(value: Column, order: Column) -> Column:
    """The first non-null value by `order`. A struct moves as a whole, so fields of one row stay together."""
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def last_known(value: Column, order: Column) -> Column:
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def distinct_in_order(df: DataFrame, keys: list[str], value: str, order: Column, cap: int | None = None, name: str = "seen") -> DataFrame:
    """For each key, the different values in the order in which they first appear, at most `cap` of them: rows are first
    reduced to one for each key and value, so a long group costs no more than its different values."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__o"))
    line = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__o"), F.col(value).alias("v")))), lambda x: x["v"])
    return firsts.groupBy(*keys).agg((F.slice(line, 1, cap) if cap else line).alias(name))


def census(df: DataFrame, keys: list[str], levels: Column, weight: Column | None = None) -> DataFrame:
    """(keys, level, rows_with): weighted rows that have a level at least once."""
    w = weight if weight is not None else F.lit(1)
    each = df.select(*keys, F.explode(F.array_distinct(levels)).alias("level"), w.cast("long").alias("w"))
    return each.groupBy(*keys, "level").agg(F.sum("w").alias("rows_with"))


def last_largest(df: DataFrame, keys: list[str], by: Column, order: Column, *values: str) -> DataFrame:
    """The row with the largest `by`; of equals the last in order."""
    row = F.struct(*(F.col(v) for v in values))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(by.alias("a"), order.alias("b"))).alias("r")).select(*keys, "r.*")


def first_largest(df: DataFrame, keys: list[str], by: Column, order: Column, *values: str) -> DataFrame:
    """The row with the largest `by`; of equals the first by a numeric order."""
    row = F.struct(*(F.col(v) for v in values))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(by.alias("a"), (-order).alias("b"))).alias("r")).select(*keys, "r.*")


def fold_with_tolerance(df: DataFrame, keys: list[str], name: str, primary: str, secondary: str, tolerance: float) -> DataFrame:
    """Main candidate of each key, in the order of `name`: a later one wins if its primary is larger by more than the
    tolerance or, within the tolerance, its secondary is larger. Not transitive, so it is a fold and not a sort; a
    group is one list of candidates' numbers (the playlists of one disc)."""
    row = F.struct(F.col(name).alias("name"), F.col(primary).cast("double").alias("p"), F.col(secondary).cast("long").alias("s"))
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("l"))

    def better(best: Column, x: Column) -> Column:
        gap = x["p"] - best["p"]
        wins = (gap > tolerance) | ((F.abs(gap) <= tolerance) & (x["s"] > best["s"]))
        return F.when(wins, x).otherwise(best)

    best = F.aggregate(F.slice(F.col("l"), F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), F.get("l", F.lit(0)), better)
    return listed.select(*keys, best.alias("b")).select(*keys, F.col("b.name").alias(name), F.col("b.p").alias(primary), F.col("b.s").alias(secondary))
