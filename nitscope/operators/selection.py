"""Which access units to look at: deterministic head-and-spread samples, bounded heads, first sufficient rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitscope.operators.windows import with_prefix_sum


def positions(n: Column, samples: int, pinned: Column | None = None) -> Column:
    """Sorted positions of a sample of `samples` among n rows: all if n is no larger; else a head of a third and a
    spread over the rest by whole-number division, and the pinned one."""
    head = max(1, samples // 3)
    rest = samples - head
    spread = F.transform(F.sequence(F.lit(1), F.lit(max(rest, 1))), lambda k: F.floor(k * (n - 1) / F.lit(rest + 1)).cast("long"))
    first = F.sequence(F.lit(0).cast("long"), F.lit(head - 1).cast("long"))
    some = F.concat(first, spread) if rest > 0 else first
    if pinned is not None:
        some = F.concat(some, F.when(pinned.isNotNull() & (pinned < n), F.array(pinned.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= samples, every).otherwise(F.array_sort(F.array_distinct(some)))


def select_rows(df: DataFrame, keys: list[str], order: list[str], samples: int, pinned: str | None = None, chunk: Column | None = None) -> DataFrame:
    """The sampled rows of each key with their position. Counts come from one small aggregation, so that positions are
    a join; with `chunk`, rows are numbered in their chunks."""
    numbered = with_prefix_sum(df.withColumn("__one", F.lit(1)), keys, order, "__one", chunk, "position").drop("__one")
    extra = [F.max(pinned).alias("__pin")] if pinned else []
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"), *extra)
    wanted = sizes.select(*keys, F.explode(positions(F.col("__n"), samples, F.col("__pin") if pinned else None)).alias("position"))
    return numbered.join(wanted, [*keys, "position"])


def bounded_head(df: DataFrame, keys: list[str], order: list[str], size: str, span: int, rows: int, chunk: Column | None = None) -> DataFrame:
    """Rows of each key until `span` units of size or `rows` rows are reached; the row that reaches it is the last."""
    past = with_prefix_sum(df.withColumn("__one", F.lit(1)), keys, order, size, chunk, "__past")
    past = with_prefix_sum(past, keys, order, "__one", chunk, "__n")
    return past.where((F.col("__past") < span) & (F.col("__n") < rows)).drop("__past", "__n", "__one")


def first_widest(df: DataFrame, keys: list[str], order: str, width: str, enough: int, *values: str) -> DataFrame:
    """The widest row, the first of equals, among those up to the first that is wide enough."""
    stop = df.groupBy(*keys).agg(F.min(F.when(F.col(width) >= enough, F.col(order))).alias("__stop"))
    seen = df.join(stop, keys).where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop")))
    row = F.struct(*(F.col(v) for v in (order, width, *values)))
    best = F.max_by(row, F.struct(F.col(width).alias("w"), (-F.col(order)).alias("o")))
    return seen.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")
