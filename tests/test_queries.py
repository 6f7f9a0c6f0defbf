"""Every registered query against its SQL on the small tables."""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import catalog, entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 150


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["budget", "source", "prompts"]
    assert df.count() > 0


# Rules that no row of the small tables breaks.
MAY_BE_EMPTY = {"retention_pair_rules"}


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, catalog()[name], SF)
    if name in MAY_BE_EMPTY and status == "EMPTY":
        return
    assert status == ("rows" if catalog()[name].sql is None else "ok"), note or f"{status}: {rows} rows"
    assert rows > 0
