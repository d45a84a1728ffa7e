"""Every registered query against its oracle on the smallest tables."""

import pytest
from check_oracle import rows_of
from conftest import SF

import __spark_entry__ as entry
from corroborate.plans import REGISTRY

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert "lang" in df.columns
    df.collect()
