"""J1-J5 on invented frames."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from legation.operators import active_members, complete, enrich, enrich_both, inactive_members


def _dim(spark):
    return spark.createDataFrame(
        [("ITA", "Italy", 5), ("FRA", "France", 5), ("KEN", "Kenya", 2)],
        "code string, name string, continent int",
    )


def _fact(spark):
    return spark.createDataFrame(
        [(1, "ITA", "FRA", "W"), (2, "ITA", "KEN", "M"), (3, "XKX", "ITA", "W"), (4, "FRA", None, None)],
        "id int, sender string, receiver string, category string",
    )


def test_enrich_keeps_unmatched(spark):
    out = enrich(_fact(spark), _dim(spark), "sender", "code", ["name", "continent"])
    assert rows(out, "id", "name", "continent") == [
        (1, "Italy", 5),
        (2, "Italy", 5),
        (3, None, None),
        (4, "France", 5),
    ]
    inner = enrich(_fact(spark), _dim(spark), "sender", "code", ["name"], how="inner")
    assert inner.count() == 3


def test_enrich_broadcasts_small_dimension(spark, workdir):
    _dim(spark).write.parquet(f"{workdir}/dim")
    out = enrich(_fact(spark), spark.read.parquet(f"{workdir}/dim"), "sender", "code", ["name"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_enrich_does_not_hint_large_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = enrich(_fact(spark), _dim(spark), "sender", "code", ["name"], max_bytes=2)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert rows(out, "id", "name")[0] == (1, "Italy")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_enrich_both_prefixes_roles(spark):
    out = enrich_both(_fact(spark), _dim(spark), "sender", "receiver", "code", ["name"])
    assert rows(out, "id", "sender_name", "receiver_name") == [
        (1, "Italy", "France"),
        (2, "Italy", "Kenya"),
        (3, None, "Italy"),
        (4, "France", None),
    ]


def test_semi_and_anti(spark):
    dim, fact = _dim(spark), _fact(spark)
    assert rows(active_members(dim, fact, "code", "sender"), "code") == [("FRA",), ("ITA",)]
    assert rows(inactive_members(dim, fact, "code", "sender"), "code") == [("KEN",)]
    women = F.col("category") == "W"
    assert rows(active_members(dim, fact, "code", "receiver", women), "code") == [("FRA",), ("ITA",)]
    assert rows(inactive_members(dim, fact, "code", "receiver", women), "code") == [("KEN",)]


def test_complete_fills_grid(spark):
    counts = spark.createDataFrame(
        [("Italy", 2001, 3), ("France", 2003, 1)], "name string, period int, n bigint"
    )
    out = complete(counts, {"name": _dim(spark).select("name"), "period": [2001, 2002, 2003]}, ["n"])
    got = rows(out)
    assert len(got) == 9
    assert ("Italy", 2001, 3) in got and ("France", 2003, 1) in got and ("Kenya", 2002, 0) in got
    seq = complete(counts, {"period": F.sequence(F.lit(2001), F.lit(2002)), "name": ["Italy"]}, ["n"])
    # Counts outside the domains stay, so that totals reconcile.
    assert rows(seq) == [(2001, "Italy", 3), (2002, "Italy", 0), (2003, "France", 1)]


def test_enrich_case_blind_only_when_asked(spark):
    fact = spark.createDataFrame([(1, "ita"), (2, "FRA")], "id int, sender string")
    exact = enrich(fact, _dim(spark), "sender", "code", ["name"])
    assert rows(exact, "id", "name") == [(1, None), (2, "France")]
    blind = enrich(fact, _dim(spark), "sender", "code", ["name"], collation="UTF8_LCASE")
    assert rows(blind, "id", "name") == [(1, "Italy"), (2, "France")]


def test_complete_null_member_keeps_counts(spark):
    counts = spark.createDataFrame([(None, 1, 4), ("a", 1, 2)], "name string, period int, n bigint")
    dom = spark.createDataFrame([(None,), ("a",)], "name string")
    out = rows(complete(counts, {"name": dom, "period": [1, 2]}, ["n"]))
    assert out == [(None, 1, 4), (None, 2, 0), ("a", 1, 2), ("a", 2, 0)]
