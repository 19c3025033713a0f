"""Joins of the pipeline: layer folding, coalesced look-ups, smallest admitting row, containment, longest prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def fold_layers(tracks: DataFrame, keys: list[str], is_layer: Column, rank: Column, order: Column, fields: list[str]) -> DataFrame:
    """Enhancement layers folded into one base track of each key: the base with the largest rank, the last of equals.
    A base's own fields win, the layer fills gaps (its first known value by order); other bases stay as they are, and
    layers without a base are tracks of their own."""
    t = tracks.withColumns({"__layer": is_layer, "__rank": rank, "__o": order})
    target = t.where(~F.col("__layer")).groupBy(*keys).agg(F.max_by("__o", F.struct("__rank", "__o")).alias("__o"), F.lit(True).alias("__target"))
    first = [F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("__o"))).alias(f"__{f}") for f in fields]
    given = t.where("__layer").groupBy(*keys).agg(*first, F.lit(True).alias("__folded"))
    based = target.select(*keys, F.lit(True).alias("__has_base"))
    rows = t.join(target, [*keys, "__o"], "left").join(given, keys, "left").join(based, keys, "left")
    alone = F.col("__layer") & F.col("__has_base").isNull()
    folded = F.col("__target").isNotNull() & F.col("__folded").isNotNull()
    out = rows.where(~F.col("__layer") | alone)
    filled = {f: F.when(folded, F.coalesce(F.col(f), F.col(f"__{f}"))).otherwise(F.col(f)) for f in fields}
    return out.select(*(filled.get(c, F.col(c)).alias(c) for c in tracks.columns), folded.alias("dual_track"))


def first_usable(left: DataFrame, right: DataFrame, on: list[str], usable: Column, order: Column, *values: str) -> DataFrame:
    """`left` with the values of the first usable right row of its key."""
    row = F.struct(*(F.col(v) for v in values))
    best = right.where(usable).groupBy(*on).agg(F.min_by(row, order).alias("__r"))
    return left.join(best, on, "left").select("*", *(F.col("__r")[v].alias(v) for v in values)).drop("__r")


def smallest_admitting(value_conditions: list[tuple[Column, int]], result: list[int]) -> Column:
    """The first result whose condition holds: limits are few and fixed, so the theta-join is a constant expression."""
    return reduce(lambda acc, x: F.when(x[0], x[1]).otherwise(acc), reversed(list(zip((c for c, _ in value_conditions), result, strict=True))), F.lit(None).cast("int"))


def contains_point(ranges: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, bin_size: int, order: str) -> DataFrame:
    """Each point (keys, `at`) once, with the first `order` among the ranges of its key that hold it, or null. A range is
    filed under the bins that it touches, at the level whose bins are at least as long as it is: at most two, however long
    it is. Points look into every level that has ranges, so the join is on equality."""
    length = F.col(end) - F.col(start)
    level = F.ceil(F.log2(F.greatest(length / bin_size, F.lit(1.0)))).cast("int")
    bin_of = lambda x, n: F.floor(x / (F.lit(bin_size) * F.pow(F.lit(2.0), n))).cast("long")
    sized = ranges.where(length > 0).withColumn("__level", level)
    levels = sorted(r[0] for r in sized.select("__level").distinct().collect())  # no more than the bits of a number
    filed = sized.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start), F.col("__level")), bin_of(F.col(end) - 1, F.col("__level")))))
    filed = filed.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__level", "__bin", F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(order).alias("__order"))
    asked = points.select(*keys, at).distinct().withColumn("__l", F.explode(F.array(*map(F.lit, levels or [0])).cast("array<int>")))
    inside = (F.col(at) >= F.col("__start")) & (F.col(at) < F.col("__end"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("__l") == F.col("__level"), bin_of(F.col(at), F.col("__l")) == F.col("__bin"), inside])
    return asked.join(filed, same, "left").groupBy(*keys, at).agg(F.min("__order").alias(order))


def complete_and_first(items: DataFrame, group: list[str], name: str, sequence: Column, present: DataFrame, on: str) -> DataFrame:
    """Names whose every item is present, and of those with equal item sequences the first by name. Items meet the present
    ones in one join and are grouped once."""
    known = present.select(F.col(on).alias("__on")).distinct()
    told = items.withColumn("__item", sequence).join(known, F.col(on) == F.col("__on"), "left")
    sequences = told.groupBy(*group, name).agg(F.every(F.col("__on").isNotNull()).alias("__whole"), F.array_sort(F.collect_list("__item")).alias("items"))
    return sequences.where("__whole").groupBy(*group, "items").agg(F.min(name).alias(name))


def longest_prefix(df: DataFrame, value: Column, prefixes: list[str]) -> Column:
    """The longest of few fixed prefixes that the value begins with, the last of equals."""
    ordered = sorted(enumerate(prefixes), key=lambda x: (len(x[1]), x[0]))
    return reduce(lambda acc, p: F.when(value.startswith(p[1]), F.lit(p[1])).otherwise(acc), ordered, F.lit(None).cast("string"))
