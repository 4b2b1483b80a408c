"""Every query beside its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from siftwork.plans.oracle import SQL
from siftwork.plans.queries import QUERIES
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.feature for r in rows] == ["the", "ion"]
    assert all(r.pos + r.neg == r.total for r in rows)
