"""Every registered query against its SQL, over all given tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracles.queries import ORACLES
from tests.compare import connect, difference
from tillworks import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    with connect(FOLDER) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    assert difference(df, con, entry_points.oracle_sql()[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) == set(registry.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship_query_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["id", "name", "slug", "price", "image_url", "total_sold",
                          "times_ordered"]
    assert df.count() == 200
