"""Every registered query against its SQL, on the test data."""

import pytest
from compare import duck, rows_of, rows_of_sql, types_of, types_of_sql

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


# Queries of the text subpackage are tested in tests/llm.
ANALYSES = sorted(driver._analyses())


def test_every_query_has_its_sql():
    assert set(ANALYSES) == set(driver._analyses_sql())


@pytest.mark.parametrize("name", ANALYSES)
def test_query_matches_sql(spark, connection, name):
    frame = driver.queries()[name](spark, SF_DIR)
    sql = driver.oracle_sql()[name]
    assert types_of(frame) == types_of_sql(connection, sql)
    names, rows = rows_of(frame)
    expected_names, expected = rows_of_sql(connection, sql)
    assert names == expected_names
    assert len(rows) > 0
    assert rows == expected


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.count() == 15
