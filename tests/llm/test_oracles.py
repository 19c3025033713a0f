"""The corpus queries that have a SQL twin, against it."""

import pytest

from nitscope.llm import oracles, queries
from tests.test_kernels import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
