"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalogue.queries import QUERIES
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
    # Only the map's components have no SQL.
    assert {n for n in QUERIES if n not in oracle_sql()} == {"pca_map"}


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["depth", "host_collective_slug", "collective_slug", "amount_in_usd"]
    assert df.count() > 0
