"""Luminance and gamut expressions: PQ codes to nits, standard mastering targets, chromaticity matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard mastering targets in nits.
STANDARD_NITS = (48, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 1000, 1500, 2000, 2500, 3000, 4000, 10000)

#: SMPTE ST 2084 constants.
M1, M2 = 2610 / 16384, 2523 / 4096 * 128
C1, C2, C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32

#: Red, green and blue of the gamuts that mastering displays use, and the white points that tell them apart.
GAMUTS = (
    ("BT.2020", (0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    ("DCI-P3 D65", (0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    ("DCI-P3", (0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3140, 0.3510)),
    ("BT.709", (0.640, 0.330), (0.300, 0.600), (0.150, 0.060), (0.3127, 0.3290)),
)
TOLERANCE = 0.0005


def pq_nits(code: Column) -> Column:
    """12-bit PQ code to cd/m2."""
    e = F.pow(code / F.lit(4095.0), F.lit(1 / M2))
    low = F.lit(C2) - F.lit(C3) * e
    return F.when(low <= 0, F.lit(0.0)).otherwise(F.lit(10000.0) * F.pow(F.greatest(e - C1, F.lit(0.0)) / low, F.lit(1 / M1)))


def nearest_standard(value: Column, standards=STANDARD_NITS) -> Column:
    """The nearest standard value within max(4 %, 10), truncated; the first of equals; else the rounded value itself."""
    n = F.floor(F.abs(value) + 0.5).cast("long") * F.signum(value).cast("long")
    near = F.filter(
        F.array(*(F.struct(F.abs(n - s).alias("d"), F.lit(i).alias("i"), F.lit(s).cast("long").alias("s"), F.lit(max(10, int(s * 0.04))).alias("tol")) for i, s in enumerate(standards))),
        lambda x: x["d"] <= x["tol"],
    )
    return F.coalesce(F.array_min(near)["s"], n)


def pq_target(code: Column) -> Column:
    return nearest_standard(pq_nits(code))


def distinct_targets(codes: Column) -> Column:
    """12-bit codes to their different standard nits, sorted."""
    return F.array_sort(F.array_distinct(F.transform(codes, pq_target)))


def source_range(low: Column, high: Column) -> Column:
    """(max_luminance, min_luminance) of a grade's PQ range; null if the maximum is zero or missing."""
    small = F.floor(pq_nits(low) * 10000.0 + 0.5) / 10000.0
    return F.when(high > 0, F.struct(pq_target(high).cast("double").alias("max_luminance"), small.alias("min_luminance")))


def gamut(red: Column, green: Column, blue: Column, white: Column) -> Column:
    """Name of the gamut whose primaries and white lie within the tolerance; the three primaries (structs x, y) may come
    in any order: the lowest y is blue, the larger x of the others is red."""
    by_y = F.array_sort(F.transform(F.array(red, green, blue), lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    b, p, q = (F.get(by_y, F.lit(i)) for i in range(3))
    swap = q["x"] > p["x"]
    r, g = F.when(swap, q).otherwise(p), F.when(swap, p).otherwise(q)

    def near(point: Column, target: tuple[float, float]) -> Column:
        return (F.abs(point["x"] - target[0]) < TOLERANCE) & (F.abs(point["y"] - target[1]) < TOLERANCE)

    out = F.lit(None).cast("string")
    for name, tr, tg, tb, tw in reversed(GAMUTS):
        out = F.when(near(r, tr) & near(g, tg) & near(b, tb) & near(white, tw), name).otherwise(out)
    return out
