"""Every registered query runs at the smallest scale and agrees with its SQL."""

import pytest

import __spark_entry__ as entry_module
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, _, message = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
