"""The operators' queries against their SQL on DuckDB, where they have some."""

import pytest

import __spark_entry__ as entries
from compare import compare, oracle_connection
from siftwell.llm.oracle import ORACLE
from siftwell.llm.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entries.queries())
    assert set(ORACLE) <= set(entries.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, sf_dir, name):
    assert compare(spark, connection, name, sf_dir) is None
