"""Registered queries against DuckDB on the smallest tables."""

import pytest
from compare import difference, duck
from conftest import SMALL

import __spark_entry__ as entry_module

from oracle.sql import ORACLES
from placehull.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["poi_id", "uid", "uid_name", "search_rank"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine, theirs, extra, lacking = difference(spark, con, QUERIES[name], ORACLES[name], SMALL)
    assert not extra and not lacking, (mine, theirs, list(extra)[:3], list(lacking)[:3])
    assert mine > 0
