"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import os

import pytest
from conftest import SMOKE_DIR
from oracle_compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from legation.plans.catalog import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    out = compare(spark, con, name, QUERIES[name], ORACLE[name], SMOKE_DIR)
    assert out.ok, out.detail


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["r_name", "n_name", "n_total", "n_category", "share", "rank"]
    assert df.count() > 0
