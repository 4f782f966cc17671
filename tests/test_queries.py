"""Every registered query against its SQL."""

import compare
import pytest

import __spark_entry__ as entry_points
from ballast.plans import queries as registered

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(registered.REGISTRY) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
