"""Every registered query against its SQL, and the shape of the contract."""

import pytest

import __spark_entry__ as contract
from check import compare, connect
from rowloom.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, db, name):
    verdict, _rows = compare(spark, db, name, SF_DIR)
    assert verdict == "ok"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())


def test_flagship_runs(spark):
    assert contract.entry(spark).count() > 0
