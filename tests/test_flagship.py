"""F1 on invented frames, direct and through a link table."""

from __future__ import annotations

import pytest
from conftest import rows

from legation.plans import category_share_ranking


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(
        [("ITA", "Italy", "Europe"), ("FRA", "France", "Europe"), ("KEN", "Kenya", "Africa")],
        "code string, name string, continent string",
    )


def test_flagship_direct(spark, dim):
    fact = spark.createDataFrame(
        [("ITA", "W"), ("ITA", "M"), ("FRA", "W"), ("FRA", "W"), ("KEN", "M"), ("XKX", "W")],
        "sender string, category string",
    )
    out = category_share_ranking(fact, dim, "sender", "category", "W", "code", "name", "continent")
    got = {r["name"]: (r["continent"], r["share"], r["rank"]) for r in out.collect()}
    assert got["France"] == ("Europe", 1.0, 1)
    assert got["Italy"] == ("Europe", 0.5, 2)
    assert got["Kenya"] == ("Africa", 0.0, 1)
    assert got[None] == (None, 1.0, None)  # sender missing from the dimension is kept, without a rank
    assert out.columns == ["continent", "name", "n_total", "n_category", "share", "rank"]


def test_flagship_through_link(spark, dim):
    people = spark.createDataFrame([(1, "ITA"), (2, "ITA"), (3, "FRA")], "person int, state string")
    fact = spark.createDataFrame(
        [(1, "W"), (1, "M"), (2, "W"), (3, "M")], "person int, category string"
    )
    out = category_share_ranking(
        fact, dim, "person", "category", "W", "code", "name", "continent", link=(people, "person", "state")
    )
    assert rows(out, "name", "n_total", "n_category", "rank") == [("France", 1, 0, 2), ("Italy", 3, 2, 1)]
