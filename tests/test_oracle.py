"""Every registered query of the core library against its SQL statement on the smallest data set."""

import pytest

import __spark_entry__ as driver
from verify.catalog import ORACLE, QUERIES
from verify.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert name in driver.queries()
    ok, note = compare(spark, oracle, name, SF, QUERIES[name], ORACLE[name])
    assert ok, note


def test_entry(spark):
    assert driver.entry(spark).count() > 0
