"""A1-A9 on invented frames: null category, zero denominator, weights."""

from __future__ import annotations

import pytest
from conftest import rows

from legation.operators import (
    bilateral_matrix,
    count_by,
    crosstab,
    distinct_partners,
    marginals,
    melt,
    parity_ratio,
    rollup_counts,
    share_by,
)

FACTS = [
    # id, sender, receiver, category, posting, continent
    (1, "ITA", "FRA", "W", "head", 5),
    (2, "ITA", "KEN", "M", "head", 5),
    (3, "ITA", "FRA", "O", "deputy", 5),
    (4, "FRA", "ITA", "M", "head", 5),
    (5, "FRA", "KEN", None, "head", 5),
    (6, "KEN", "ITA", "M", "deputy", 2),
]


@pytest.fixture
def facts(spark):
    return spark.createDataFrame(
        FACTS, "id int, sender string, receiver string, category string, posting string, continent int"
    )


def test_count_by(facts):
    assert rows(count_by(facts, "sender")) == [("FRA", 2), ("ITA", 3), ("KEN", 1)]


def test_share_by_null_category_and_group_without_target(facts):
    out = {r["sender"]: (r["n_total"], r["n_category"], r["share"]) for r in share_by(facts, "sender", "category", "W").collect()}
    assert out["ITA"] == (3, 1, pytest.approx(1 / 3))
    assert out["FRA"] == (1, 0, 0.0)  # null category not in the denominator
    assert out["KEN"] == (1, 0, 0.0)


def test_share_by_weighted_equals_raw(facts):
    pre = count_by(facts, "sender", "category")
    raw = rows(share_by(facts, "sender", "category", "W"))
    weighted = rows(share_by(pre, "sender", "category", "W", weight="n"))
    assert raw == weighted


def test_parity_ratio_zero_denominator_is_null(facts):
    out = {r["sender"]: r["ratio"] for r in parity_ratio(facts, "sender", "category", "W", "M").collect()}
    assert out == {"ITA": 1.0, "FRA": 0.0, "KEN": 0.0}
    out = {r["sender"]: r["ratio"] for r in parity_ratio(facts, "sender", "category", "M", "W").collect()}
    assert out == {"ITA": 1.0, "FRA": None, "KEN": None}


def test_distinct_partners(facts):
    assert rows(distinct_partners(facts, "sender", "receiver")) == [("FRA", 2), ("ITA", 2), ("KEN", 1)]
    approx = rows(distinct_partners(facts, "sender", "receiver", approx=True))
    assert approx == [("FRA", 2), ("ITA", 2), ("KEN", 1)]


def test_rollup_counts_flags_subtotals(facts):
    out = rows(rollup_counts(facts, ["continent", "sender"]))
    assert (None, None, 6, 1, 1) in out
    assert (5, None, 5, 0, 1) in out
    assert (2, "KEN", 1, 0, 0) in out
    assert len(out) == 3 + 2 + 1


def test_marginals(facts):
    out = marginals(facts, [["sender", "category"], ["posting"]])
    got = rows(out, "sender", "category", "posting", "n")
    assert (None, None, "head", 4) in got and (None, None, "deputy", 2) in got
    assert ("ITA", "W", None, 1) in got
    assert out.columns == ["sender", "category", "posting", "n", "g_sender", "g_category", "g_posting"]


def test_crosstab_and_melt(facts):
    tab = crosstab(facts, "posting", "category", ["W", "M", "O"])
    assert rows(tab) == [("deputy", 0, 1, 1), ("head", 1, 2, 0)]
    long = melt(tab, "posting", ["W", "M", "O"], "category", "n")
    assert ("head", "O", 0) in rows(long) and len(rows(long)) == 6


def test_bilateral_matrix(spark, facts):
    dim = spark.createDataFrame(
        [("ITA", "Europe"), ("FRA", "Europe"), ("KEN", "Africa")], "code string, continent_name string"
    )
    out = bilateral_matrix(facts, dim, "sender", "receiver", "code", "continent_name")
    assert rows(out) == [
        ("Africa", "Europe", 1),
        ("Europe", "Africa", 2),
        ("Europe", "Europe", 3),
    ]


def test_empty_input(facts):
    empty = facts.limit(0)
    assert share_by(empty, "sender", "category", "W").count() == 0
    assert crosstab(empty, "posting", "category", ["W"]).count() == 0


def test_melt_odd_column_names(spark):
    tab = spark.createDataFrame([("x", 1, 2)], "`row.id` string, `1-URGENT` bigint, `a.b` bigint")
    out = melt(tab, "row.id", ["1-URGENT", "a.b"], "priority", "n")
    assert rows(out) == [("x", "1-URGENT", 1), ("x", "a.b", 2)]


def test_crosstab_counts_null_category_when_asked(facts):
    tab = crosstab(facts, "posting", "category", ["W", None])
    assert rows(tab) == [("deputy", 0, 0), ("head", 1, 1)]
    assert tab.columns == ["posting", "W", "None"]
