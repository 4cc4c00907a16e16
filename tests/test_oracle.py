"""Every catalog query against its SQL."""

import pytest
from conftest import MEDIUM, SMALL
from oracle_check import connect, mismatch

from plantpulse.plans.catalog import queries
from plantpulse.plans.oracle import oracle_sql


@pytest.fixture(scope="module", params=[SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
def tables(request):
    con = connect(request.param)
    yield request.param, con
    con.close()


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, tables, name):
    sf_dir, con = tables
    assert mismatch(spark, con, sf_dir, name) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
