"""Ties, tie-breaks, gaps."""

from __future__ import annotations

import pytest
from conftest import rows

from legation.operators import change_over, rank_within, share_of_total, top_k, top_n_per_group


@pytest.fixture
def counts(spark):
    return spark.createDataFrame(
        [
            ("Europe", "Italy", 10),
            ("Europe", "France", 10),
            ("Europe", "Spain", 5),
            ("Africa", "Kenya", 4),
            ("Africa", "Ghana", 1),
            (None, "Nowhere", 5),
        ],
        "continent string, name string, n bigint",
    )


def test_share_of_parent_and_total(counts):
    out = {r["name"]: r["share"] for r in share_of_total(counts, "n", parent="continent").collect()}
    assert out["Italy"] == pytest.approx(0.4) and out["Kenya"] == pytest.approx(0.8)
    assert out["Nowhere"] == 1.0  # null parent is a parent of its own
    total = {r["name"]: r["share"] for r in share_of_total(counts, "n").collect()}
    assert total["Spain"] == pytest.approx(5 / 35)


def test_rank_within_ties_share_rank(counts):
    out = {r["name"]: r["rank"] for r in rank_within(counts, "continent", "n").collect()}
    assert out["Italy"] == out["France"] == 1 and out["Spain"] == 2
    assert out["Kenya"] == 1 and out["Ghana"] == 2


def test_top_n_needs_and_uses_tie_break(counts):
    with pytest.raises(ValueError):
        top_n_per_group(counts, "continent", "n", 1, tie_break=[])
    out = top_n_per_group(counts, "continent", "n", 1, tie_break="name")
    assert rows(out, "continent", "name") == sorted(
        [("Europe", "France"), ("Africa", "Kenya"), (None, "Nowhere")], key=lambda r: (r[0] is not None, r)
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_change_over_gap_gives_null(spark):
    df = spark.createDataFrame(
        [("A", 2001, 1.0), ("A", 2002, 3.0), ("A", 2004, 4.0), ("B", 2002, 2.0)],
        "k string, period int, v double",
    )
    out = {(r["k"], r["period"]): (r["previous"], r["change"]) for r in change_over(df, "period", "v", "k").collect()}
    assert out[("A", 2002)] == (1.0, 2.0)
    assert out[("A", 2004)] == (None, None)
    assert out[("B", 2002)] == (None, None)
    plain = change_over(df.where("k = 'A'"), "period", "v")
    assert rows(plain, "period", "change") == [(2001, None), (2002, 2.0), (2004, None)]


def test_top_k_total_order(counts):
    out = top_k(counts, "n", 3, tie_break="name")
    assert [r["name"] for r in out.collect()] == ["France", "Italy", "Nowhere"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_rank_large_groups_matches_window(spark):
    from pyspark.sql import functions as F

    # one group with many distinct values (it spans several range slices),
    # a small one, a null group and repeated values
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.lit("small")).when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.lit("big")).alias("g"),
        (F.col("id") % 4_000).alias("v"),
    )
    split = rank_within(df, "g", "v", large_groups=True)
    plain = rank_within(df, "g", "v")
    assert split.count() == df.count()
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
    assert split.where("g = 'big'").agg(F.max("rank")).first()[0] == 3_200
