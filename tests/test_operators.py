"""Operators over made rows: equal results with and without chunks and for every bin size, and equal to plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from nitscope.operators import lookups, selection, windows

KEYS, ORDER = ["k"], ["at"]


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(11)
    return [(k, i, rnd.choice((None, "a", "b")), rnd.randint(0, 9)) for k in range(5) for i in range(rnd.choice((1, 3, 60)))]


@pytest.fixture(scope="module")
def rows(spark, made):
    return spark.createDataFrame(made, "k int, at int, v string, n int").repartition(3)


def lines(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def chunks():
    return F.floor(F.col("at") / 7), F.col("at"), F.lit(0)


MAKERS = {
    "previous": lambda df, c: windows.with_previous(df, KEYS, ORDER, "v", c),
    "prefix": lambda df, c: windows.with_prefix_sum(df, KEYS, ORDER, "n", c),
    "runs": lambda df, c: windows.runs(df, KEYS, ORDER, "v", c),
    "as_of": lambda df, c: windows.as_of(df, KEYS, ORDER, F.col("v"), chunk=c),
    "units": lambda df, c: windows.access_units(df, KEYS, ORDER, F.col("n") < 4, F.col("n") == 5, chunk=c),
    "merged": lambda df, c: windows.merge_intervals(df.select("k", "at", (F.col("at") + F.col("n") / 4).alias("to")), KEYS, "at", "to", c),
    "coalesced": lambda df, c: windows.coalesce_all(df.select("k", "at", (F.col("at") + 1 + (F.col("k") == 2).cast("int")).alias("to")), KEYS, ORDER, "at", "to", c),
    "selected": lambda df, c: selection.select_rows(df, KEYS, ORDER, 7, chunk=c),
    "head": lambda df, c: selection.bounded_head(df, KEYS, ORDER, "n", 30, 9, chunk=c),
}


@pytest.mark.parametrize("name", MAKERS)
def test_chunks_change_nothing(rows, name):
    want = lines(MAKERS[name](rows, None))
    for c in chunks():
        assert lines(MAKERS[name](rows, c)) == want
    assert MAKERS[name](rows.limit(0), chunks()[0]).count() == 0


def test_runs_of_plain_python(rows, made):
    want = []
    for k, group in groupby(sorted(made, key=lambda r: r[:2]), key=lambda r: r[0]):
        want += [(k, i, v, len(list(g))) for i, (v, g) in enumerate(groupby(group, key=lambda r: r[2]))]
    got = windows.runs(rows, KEYS, ORDER, "v", chunks()[0]).select("k", "run", "v", "n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", (1, 4, 8, 64))
def test_containment_for_every_bin_size(spark, size):
    rnd = random.Random(3)
    ranges = [(k, a, a + rnd.choice((0, 1, 5, 70, 5000)), i) for i, (k, a) in enumerate((rnd.randint(0, 2), rnd.randint(0, 200)) for _ in range(40))]
    points = [(k, x) for k in range(4) for x in range(-3, 260, 3)]
    got = lookups.contains_point(spark.createDataFrame(ranges, "k int, a long, b long, i int"), spark.createDataFrame(points * 2, "k int, x long"), ["k"], "a", "b", "x", size, "i")
    want = {(k, x): min((i for g, a, b, i in ranges if g == k and a <= x < b), default=None) for k, x in points}
    assert {(r.k, r.x): r.i for r in got.collect()} == want and got.count() == len(points)
    none = lookups.contains_point(spark.createDataFrame([], "k int, a long, b long, i int"), spark.createDataFrame([(1, 60)], "k int, x long"), ["k"], "a", "b", "x", size, "i")
    assert [tuple(r) for r in none.collect()] == [(1, 60, None)]


def test_a_long_range_takes_two_rows_at_most(spark):
    one = spark.createDataFrame([(1, 0, 1 << 40, 7)], "k int, a long, b long, i int")
    hit = lookups.contains_point(one, spark.createDataFrame([(1, (1 << 40) - 1), (1, 1 << 40)], "k int, x long"), ["k"], "a", "b", "x", 4, "i")
    assert sorted(tuple(r) for r in hit.collect()) == [(1, (1 << 40) - 1, 7), (1, 1 << 40, None)]


def test_complete_and_first(spark):
    items = spark.createDataFrame([(1, n, c) for n, cs in (("a", "xy"), ("b", "xy"), ("c", "xz"), ("d", "x")) for c in cs], "g int, name string, clip string")
    present = spark.createDataFrame([("x",), ("y",), ("y",)], "clip string")
    got = lookups.complete_and_first(items, ["g"], "name", F.col("clip"), present, "clip")
    assert sorted((r.name, r["items"]) for r in got.collect()) == [("a", ["x", "y"]), ("d", ["x"])]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from nitscope import runtime

    none = SimpleNamespace(get=lambda *_: None)
    for master, fine in (("spark://host:7077", False), ("yarn", False), ("local[2]", True)):
        session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master=master, applicationId="app-x"))
        if fine:
            assert runtime.checkpoint_root(session).startswith("file://")
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                runtime.checkpoint_root(session)
