"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from verify import compare, connect

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, con, SQL[name]) == []
    else:
        assert df.collect()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
