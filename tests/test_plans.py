"""Physical plans of the registered queries: JVM-only, pruned, broadcast where proven small."""

from __future__ import annotations

import os
import re

import pytest
from conftest import SMOKE_DIR

from __spark_entry__ import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="driver tables not present")

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")


def plan(spark, name: str) -> str:
    df = queries()[name](spark, SMOKE_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_in_any_plan(spark, name):
    text = plan(spark, name)
    assert not [n for n in PYTHON_NODES if n in text]


def test_flagship_plan(spark):
    text = plan(spark, "f1_category_share_ranking")
    assert "BroadcastHashJoin" in text
    orders_scan = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*orders\.parquet", text)
    assert orders_scan is not None
    read = {c.split("#")[0] for c in orders_scan.group(1).split(",")}
    assert read == {"o_custkey", "o_orderstatus"}  # the scan reads two of six columns
    # orders are counted per customer before the customer join
    assert text.index("partial_count") > text.index("BroadcastHashJoin")


def test_filter_pushdown(spark):
    text = plan(spark, "p5_filter_appointments")
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text or "GreaterThanOrEqual(o_orderdate" in text
    assert "In(o_orderstatus" in text or "o_orderstatus IN" in text


def test_top_n_is_group_limited(spark):
    assert "WindowGroupLimit" in plan(spark, "w3_top_n_per_group")
    assert "TakeOrderedAndProject" in plan(spark, "l1_top_k")


def test_partition_pruning_on_loaded_table(spark):
    assert "PartitionFilters: [isnotnull(period" in plan(spark, "s3_load_table")
