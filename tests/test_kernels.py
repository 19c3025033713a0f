"""Every kernel against its SQL twin in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from nitscope.plans import bytes as byte_queries
from nitscope.plans import files, kernels

ALL = kernels.QUERIES | byte_queries.QUERIES | files.QUERIES
TWINS = kernels.ORACLE_SQL | byte_queries.ORACLE_SQL | files.ORACLE_SQL
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def same(name, df, duck):
    got = duck.execute(TWINS[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(ALL))
def test_kernel(spark, duck, name):
    same(name, ALL[name](spark, SF), duck)


def test_partition_counts_do_not_matter(spark, duck):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for name in ("cadence", "run_length", "first_wins", "prefix_sums", "fold_layers"):
                same(name, kernels.QUERIES[name](spark, SF), duck)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
