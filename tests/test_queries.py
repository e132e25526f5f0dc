"""Every registered query with a SQL counterpart gives the same rows as DuckDB does."""

import pytest
from compare import oracle_connection, oracle_rows, spark_rows
from conftest import SF_DIR

from retailflow.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    names, got = spark_rows(QUERIES[name](spark, SF_DIR))
    want_names, want = oracle_rows(connection, ORACLES[name])
    assert names == want_names
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
