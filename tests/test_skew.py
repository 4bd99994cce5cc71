"""One key holding a third of all rows: results stay whole, plans stay split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from legation.operators import active_members, count_by, enrich, share_by, top_n_per_group

N = 120_000


@pytest.fixture(scope="module")
def skewed(spark):
    # Sender 0 holds every third row; the others share the rest evenly.
    ids = spark.range(N)
    sender = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1)
    category = F.element_at(F.array(F.lit("W"), F.lit("M"), F.lit("O")), (F.col("id") % 7 % 3 + 1).cast("int"))
    return ids.select("id", sender.alias("sender"), category.alias("category"))


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(0, 998).select(F.col("id").alias("code"), F.concat(F.lit("S"), F.col("id")).alias("name"))


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_partially_aggregate_before_shuffle(skewed):
    out = count_by(skewed, "sender")
    plan = _plan(out)
    assert "partial_count" in plan
    got = {r["sender"]: r["n"] for r in out.collect()}
    assert got[0] == N // 3 and sum(got.values()) == N


def test_share_of_hot_sender_is_whole(skewed):
    out = {r["sender"]: r for r in share_by(skewed, "sender", "category", "W").collect()}
    hot = skewed.where("sender = 0")
    assert out[0]["n_total"] == hot.count()
    assert out[0]["n_category"] == hot.where("category = 'W'").count()


def test_semi_join_dedupes_hot_key_first(spark, skewed, dim):
    out = active_members(dim, skewed, "code", "sender")
    plan = _plan(out)
    assert "LeftSemi" in plan
    # the fact keys are aggregated (one row per key) below the join
    assert plan.index("HashAggregate(keys=[__member_key") > plan.index("LeftSemi")
    assert out.count() == 998


def test_shuffled_join_splits_hot_partition(spark, skewed, dim):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = enrich(skewed, dim, "sender", "code", ["name"], max_bytes=10)
        plan = _plan(out)
        assert "SortMergeJoin" in plan and "skew=true" in plan
        assert out.count() == N
        assert out.where("name = 'S0'").count() == N // 3
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_top_n_of_hot_group_is_limited_map_side(skewed):
    out = top_n_per_group(skewed, "sender", "id", 3, tie_break="category")
    plan = _plan(out)
    assert plan.count("WindowGroupLimit") >= 2  # a partial limit before the shuffle, then the final
    hot = sorted(r["id"] for r in out.where("sender = 0").collect())
    assert hot == [N - 3 * k for k in (3, 2, 1)]  # the three largest multiples of 3 below N

