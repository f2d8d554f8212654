"""Every registered query against its SQL, on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check
import registered

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("driver tables not present")
    return oracle_check.connect(SMALL)


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(registered.ORACLES)
    assert set(registered.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert oracle_check.difference(spark, con, name, SMALL) is None


def test_entry(spark, con):
    assert {r.tag for r in entry.entry(spark).collect()} == {"first", "second"}
