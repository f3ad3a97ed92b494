"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from catalog import registry
from tests.check import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["document", "method", "error", "filled_properties", "filled_ratio"]
    assert frame.count() == 3000


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, connection, name):
    frame = entry.queries()[name](spark, FOLDER)
    assert difference(name, frame, connection, entry.oracle_sql()[name]) is None
