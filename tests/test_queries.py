"""Every named query against its SQL, on the smallest tables."""

import pytest

from check_oracles import compare, database
from sensorlab.plans import all_queries

QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, sf_dir, name):
    ok, note = compare(spark, connection, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, note


def test_entry_points(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 9
