"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entries
from compare import compare, oracle_connection
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


def test_entry(spark):
    frame = entries.entry(spark)
    assert frame.count() == 6 and "distinct_count" in frame.columns


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entries.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, sf_dir, name):
    assert compare(spark, connection, name, sf_dir) is None
