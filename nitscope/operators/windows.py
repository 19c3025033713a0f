"""Operators over ordered rows: comparisons with the row before, runs, prefix sums, as-of values, merged intervals.

A group is a track, and one track may hold a large share of all rows. `chunk`, where it is given, is a column that is
monotone in the order (a day, a range of offsets): rows are then sorted within chunks only, and what crosses a border
is carried by one row for each chunk. Results are the same with and without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column | None = None, name: str = "prev") -> DataFrame:
    """Adds the value of the row before. With `chunk`, borders are bridged by each chunk's last row."""
    if chunk is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    df = df.withColumn("__chunk", chunk)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    ends = df.groupBy(*keys, "__chunk").agg(last.alias("e"))
    before = ends.select(*keys, "__chunk", F.lag("e").over(Window.partitionBy(*keys).orderBy("__chunk")).alias("__before"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    inner = df.withColumns({"__n": F.row_number().over(w), "__p": F.lag(value).over(w)})
    out = inner.join(before, [*keys, "__chunk"])
    return out.withColumn(name, F.when(F.col("__n") == 1, F.col("__before.v")).otherwise(F.col("__p"))).drop("__chunk", "__n", "__p", "__before")


def with_prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of `value` over all earlier rows (exclusive)."""

    def running(w):
        return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    if chunk is None:
        return df.withColumn(name, running(Window.partitionBy(*keys).orderBy(*order)))
    df = df.withColumn("__chunk", chunk)  # any that was there already has gone into it
    sums = df.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__s"))
    w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "__chunk", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__base"))
    inner = df.withColumn("__r", running(Window.partitionBy(*keys, "__chunk").orderBy(*order)))
    return inner.join(base, [*keys, "__chunk"]).withColumn(name, (F.col("__r") + F.col("__base")).cast("long")).drop("__chunk", "__r", "__base")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """(keys, run, value, n): consecutive equal values as one row each, numbered from 0. Rows are moved once, to their
    chunk; a chunk's first and last value and its number of runs tell where its runs stand among all."""
    part = ["__chunk"] if chunk is not None else []
    rows = df.withColumn("__v", F.struct(F.col(value)))
    if part:
        rows = rows.withColumn("__chunk", chunk)
    w = Window.partitionBy(*keys, *part).orderBy(*order)
    same = F.coalesce(F.lag("__v").over(w).eqNullSafe(F.col("__v")), F.lit(False))
    local = rows.withColumn("__new", (~same).cast("int"))
    local = local.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    mine = local.groupBy(*keys, *part, "__run").agg(F.first("__v").alias("__v"), F.count("*").alias("n"))
    if not part:
        return mine.select(*keys, F.col("__run").cast("long").alias("run"), F.col("__v")[value].alias(value), "n")
    ends = mine.groupBy(*keys, "__chunk").agg(F.min_by("__v", "__run").alias("__first"), F.max_by("__v", "__run").alias("__last"), F.count("*").alias("__runs"))
    by = Window.partitionBy(*keys).orderBy("__chunk")
    goes_on = F.coalesce(F.lag("__last").over(by).eqNullSafe(F.col("__first")), F.lit(False)).cast("int")
    ends = ends.withColumn("__on", goes_on)
    base = ends.select(*keys, "__chunk", (F.coalesce(F.sum(F.col("__runs") - F.col("__on")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__on")).alias("__base"))
    placed = mine.join(base, [*keys, "__chunk"]).withColumn("run", (F.col("__base") + F.col("__run")).cast("long"))
    return placed.groupBy(*keys, "run").agg(F.first(F.col("__v")[value]).alias(value), F.sum("n").alias("n"))


def _with_carry(df: DataFrame, keys: list[str], value: Column, fold, carry, chunk: Column, name: str) -> DataFrame:
    """`df` with `__chunk` and with `name`: what `carry` makes, over all earlier chunks, of each chunk's `fold` of `value`."""
    df = df.withColumn("__chunk", chunk)
    ends = df.groupBy(*keys, "__chunk").agg(fold(value).alias("__e"))
    past = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(ends.select(*keys, "__chunk", carry(F.col("__e")).over(past).alias(name)), [*keys, "__chunk"])


def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


def _last_by(order: list[str]):
    return lambda value: F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def as_of(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "as_of", chunk: Column | None = None) -> DataFrame:
    """Adds the last non-null `value` at or before each row."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, _last(value).over(w))
    df = _with_carry(df.withColumn("__value", value), keys, F.col("__value"), _last_by(order), _last, chunk, "__before")
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(_last(F.col("__value")).over(w), F.col("__before"))).drop("__value", "__before", "__chunk")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, chunk: Column | None = None) -> DataFrame:
    """Union of intervals: overlapping or adjacent ones become one. `chunk` must be monotone in the start."""
    part, before = ([], F.lit(None)) if chunk is None else (["__chunk"], F.col("__before"))
    if part:
        df = _with_carry(df, keys, F.col(end), F.max, F.max, chunk, "__before")
    w = Window.partitionBy(*keys, *part).orderBy(start, end)
    own = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(own, before) if part else own
    fresh = df.withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    # the island's number is how many began before the row, itself included
    numbered = with_prefix_sum(fresh, keys, [start, end], "__new", F.col("__chunk") if part else None, "__i")
    island = numbered.withColumn("__i", F.col("__i") + F.col("__new"))
    return island.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")


def coalesce_all(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, chunk: Column | None = None) -> DataFrame:
    """One range for each key if every extent begins exactly where the one before ends, else nulls."""
    told = with_previous(df, keys, order, end, chunk, "__end_before")
    joined = told.withColumn("__ok", F.col("__end_before").isNull() | (F.col("__end_before") == F.col(start)))
    ok = F.every("__ok")
    return joined.groupBy(*keys).agg(F.when(ok, F.min(start)).alias(start), F.when(ok, F.max(end)).alias(end))


def access_units(df: DataFrame, keys: list[str], order: list[str], is_picture: Column, is_leader: Column, name: str = "unit", chunk: Column | None = None) -> DataFrame:
    """Adds the number of the access unit. A row begins one if it is the first, or is a picture or a leader and the last
    such row before it is a picture."""
    part = [] if chunk is None else ["__chunk"]
    marked = df.withColumns({"__pic": is_picture, "__sig": is_picture | is_leader})
    said = F.when(F.col("__sig"), F.col("__pic"))
    if part:
        marked = _with_carry(marked, keys, said, _last_by(order), _last, chunk, "__before")
        first_chunk = marked.groupBy(*keys).agg(F.min("__chunk").alias("__first"))
        marked = marked.join(first_chunk, keys)
    w = Window.partitionBy(*keys, *part).orderBy(*order)
    last = _last(said).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    if part:
        last, first = F.coalesce(last, F.col("__before")), first & (F.col("__chunk") == F.col("__first"))
    out = marked.withColumn("__b", (first | (F.col("__sig") & F.coalesce(last, F.lit(False)))).cast("int")).drop("__before", "__first")
    out = with_prefix_sum(out, keys, order, "__b", F.col("__chunk") if part else None, name)
    return out.withColumn(name, F.col(name) + F.col("__b") - 1).drop("__pic", "__sig", "__b")


def clock_span(df: DataFrame, keys: list[str], order: Column, ticks: Column, broken: Column, modulus: int, rate: int, limit_secs: int) -> DataFrame:
    """Seconds from the first to the last clock value, unwrapped once at `modulus`; null if a row is broken or the span
    is not within (0, limit]."""
    first, last = F.min_by(ticks, order), F.max_by(ticks, order)
    span = F.when(last < first, last - first + modulus).otherwise(last - first)
    secs = span / F.lit(float(rate))
    good = ~F.bool_or(broken) & (secs > 0) & (secs <= limit_secs)
    return df.groupBy(*keys).agg(F.when(good, secs).alias("secs"))


def uniform_step(df: DataFrame, keys: list[str], order: Column, step: Column, count: Column) -> DataFrame:
    """The one step all entries share, null if they differ; entries of count 0 are skipped, and so is a last entry of
    count 1 behind others."""
    rows = df.where(count > 0).select(*keys, order.alias("__o"), step.alias("__s"), count.alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__o")
    marked = rows.withColumns({"__n": F.row_number().over(w), "__next": F.lead("__o").over(w)})
    kept = marked.where(~((F.col("__c") == 1) & F.col("__next").isNull() & (F.col("__n") > 1)))
    return kept.groupBy(*keys).agg(F.when(F.min("__s") == F.max("__s"), F.min("__s")).alias("step"))
