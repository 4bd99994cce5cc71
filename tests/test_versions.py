"""Added, removed, changed, nulls equal."""

from __future__ import annotations

import pytest
from conftest import rows

from legation.operators import diff_versions, latest_per_key, merge_versions, whole_row_changes

SCHEMA = "code string, name string, continent int"


@pytest.fixture
def old(spark):
    return spark.createDataFrame(
        [("ITA", "Italy", 5), ("SCG", "Serbia and Montenegro", 5), ("TUR", "Turkey", None)], SCHEMA
    )


@pytest.fixture
def new(spark):
    return spark.createDataFrame(
        [("ITA", "Italy", 5), ("SRB", "Serbia", 5), ("TUR", "Türkiye", 4), ("XXX", None, None)], SCHEMA
    )


def test_merge_versions_new_wins(old, new):
    out = rows(merge_versions(old, new, "code"))
    assert out == [
        ("ITA", "Italy", 5),
        ("SCG", "Serbia and Montenegro", 5),
        ("SRB", "Serbia", 5),
        ("TUR", "Türkiye", 4),
        ("XXX", None, None),
    ]


def test_latest_per_key_is_deterministic_on_ties(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), ("A", 0, "z")], "k string, v int, p string")
    assert rows(latest_per_key(df, "k", "v")) == [("A", "y")]


def test_diff_versions(old, new):
    out = {r["code"]: r for r in diff_versions(old, new, "code").collect()}
    assert set(out) == {"SCG", "SRB", "TUR", "XXX"}
    assert out["SCG"]["change"] == "removed" and out["SCG"]["new_name"] is None
    assert out["SRB"]["change"] == "added" and out["SRB"]["old_name"] is None
    assert out["TUR"]["change"] == "changed"
    assert (out["TUR"]["old_continent"], out["TUR"]["new_continent"]) == (None, 4)


def test_diff_versions_nulls_compare_equal(spark):
    a = spark.createDataFrame([("K", None, None)], SCHEMA)
    assert diff_versions(a, a, "code").count() == 0


def test_whole_row_changes(old, new):
    out = rows(whole_row_changes(old, new), "code", "side", "n")
    assert out == [("SCG", "old", 1), ("SRB", "new", 1), ("TUR", "new", 1), ("TUR", "old", 1), ("XXX", "new", 1)]


def test_whole_row_changes_counts_copies(spark):
    a = spark.createDataFrame([("K", 1)] * 5 + [("L", None)] * 2, "k string, v int")
    b = spark.createDataFrame([("K", 1)] * 2 + [("L", None)] * 2 + [("M", 3)], "k string, v int")
    assert rows(whole_row_changes(a, b)) == [("K", 1, "old", 3), ("M", 3, "new", 1)]
