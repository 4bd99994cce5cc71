"""S1-S4 on small files written by the tests themselves."""

from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from legation.operators import assign_names
from legation.sources import export_feed, load_table, read_delimited, read_table, read_with_rejects

COUNTRY_SCHEMA = StructType(
    [
        StructField("column1", StringType(), False),
        StructField("column2", StringType(), False),
        StructField("column3", IntegerType(), False),
    ]
)

# Invented rows in the shape of a country table: ';'-separated, UTF-8 with a
# byte-order mark, a comma inside a name, diacritics and an apostrophe.
GOOD_LINES = [
    "column1;column2;column3",
    "AAA;Alpha, Republic of;2",
    "BBB;Bétaland;5",
    "CCC;Côte d'Gamma;2",
    "DDD;Delta (Islands);6",
]


def _write(path: str, lines: list[str]) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(b"\xef\xbb\xbf" + ("\n".join(lines) + "\n").encode("utf-8"))
    return path


def test_read_delimited_bom_and_text(spark, workdir):
    path = _write(f"{workdir}/countries.csv", GOOD_LINES)
    df = read_delimited(spark, path, COUNTRY_SCHEMA)
    assert df.columns == ["column1", "column2", "column3"]
    named = assign_names(df, {"column1": "country_code", "column2": "country_name", "column3": "continent_code"})
    assert rows(named) == [
        ("AAA", "Alpha, Republic of", 2),
        ("BBB", "Bétaland", 5),
        ("CCC", "Côte d'Gamma", 2),
        ("DDD", "Delta (Islands)", 6),
    ]


def test_read_delimited_fails_fast_on_bad_integer(spark, workdir):
    path = _write(f"{workdir}/bad.csv", GOOD_LINES + ["EEE;Epsilon;x"])
    with pytest.raises(Exception):
        read_delimited(spark, path, COUNTRY_SCHEMA).collect()


def test_read_delimited_refuses_other_header(spark, workdir):
    path = _write(f"{workdir}/renamed.csv", ["code;name;continent", "AAA;Alpha;2"])
    with pytest.raises(Exception):
        read_delimited(spark, path, COUNTRY_SCHEMA).collect()


def test_read_with_rejects_splits_defects(spark, workdir):
    lines = GOOD_LINES + [
        "EEE;Epsilon;x",  # bad integer
        "FFF;;3",  # missing value in a required field
        "GGG;Gamma",  # short row
        "hhh;lower case;4",  # readable: codes are checked later, not by the reader
    ]
    path = _write(f"{workdir}/mixed.csv", lines)
    good, bad = read_with_rejects(spark, path, COUNTRY_SCHEMA)
    assert rows(good, "column1") == [("AAA",), ("BBB",), ("CCC",), ("DDD",), ("hhh",)]
    reasons = dict(rows(bad, "column1", "_reject_reason"))
    assert reasons["EEE"] == "bad column3"
    assert reasons["FFF"] == "missing column2"
    assert "GGG" in reasons and "column3" in reasons["GGG"]
    # Selecting one column of ``good`` must not change which rows are good.
    assert good.select("column1").count() == 5
    assert good.schema["column3"].dataType == IntegerType()


def test_export_feed_round_trip(spark, workdir):
    df = spark.createDataFrame(
        [("AAA", 3, 0.25), ("BBB", 0, None), ("C;C", 1, 1.0)], "code string, n bigint, share double"
    )
    path = export_feed(df, f"{workdir}/feed")
    back = read_delimited(spark, path, df.schema)
    assert rows(back) == rows(df)


def test_load_table_partitions_and_prunes(spark, workdir):
    df = spark.createDataFrame(
        [(i, "F" if i % 3 else "M", 2000 + i % 4) for i in range(60)],
        "id bigint, category string, period int",
    )
    path = load_table(df, f"{workdir}/appointments", partition_by=["period", "category"])
    assert sorted(os.listdir(path))[0].startswith("period=")
    table = read_table(spark, path)
    kept = table.where((F.col("period") == 2001) & (F.col("category") == "M"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "period" in plan
    expected = df.where((F.col("period") == 2001) & (F.col("category") == "M"))
    assert rows(kept, "id") == rows(expected, "id")
    # Overwriting one partition keeps the others (dynamic overwrite).
    load_table(df.where(F.col("period") == 2001).limit(1), path, partition_by=["period", "category"])
    assert read_table(spark, path).where(F.col("period") == 2000).count() == 15


def test_schema_types_kept(spark, workdir):
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    path = _write(f"{workdir}/ids.csv", ["id;name", "1;a", "2;b"])
    df = read_delimited(spark, path, schema)
    assert df.schema["id"].dataType == LongType()
    assert rows(df) == [(1, "a"), (2, "b")]


def test_load_with_rejects_one_pass(spark, workdir):
    from legation.sources import good_rows, load_with_rejects, rejected_rows

    lines = GOOD_LINES + ["EEE;Epsilon;x", "GGG;Gamma"]
    path = _write(f"{workdir}/mixed.csv", lines)
    table = load_with_rejects(spark, path, COUNTRY_SCHEMA, f"{workdir}/loaded", partition_by=["column3"])
    assert {"_rejected=false", "_rejected=true"} <= set(os.listdir(table))
    good = good_rows(spark, table)
    assert rows(good, "column1", "column3") == [("AAA", 2), ("BBB", 5), ("CCC", 2), ("DDD", 6)]
    bad = dict(rows(rejected_rows(spark, table), "column1", "_reject_reason"))
    assert bad["EEE"] == "bad column3" and "GGG" in bad


def test_read_with_rejects_date_format(spark, workdir):
    from pyspark.sql.types import DateType

    schema = StructType([StructField("code", StringType()), StructField("day", DateType())])
    path = _write(f"{workdir}/days.csv", ["code;day", "A;31/12/2020", "B;2020-12-31"])
    good, bad = read_with_rejects(spark, path, schema, formats={"day": "dd/MM/yyyy"})
    import datetime as dt

    assert rows(good) == [("A", dt.date(2020, 12, 31))]
    assert rows(bad) == [("B", "2020-12-31", "bad day")]


def test_bucketed_tables_join_without_shuffle(spark, workdir):
    import uuid

    suffix = uuid.uuid4().hex[:8]
    orders = spark.range(2_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    lines = spark.range(8_000).select((F.col("id") % 2_000).alias("k"), F.col("id").alias("line"))
    load_table(orders, f"{workdir}/o", bucket_by=(8, ["k"]), table=f"o_{suffix}")
    load_table(lines, f"{workdir}/l", bucket_by=(8, ["k"]), table=f"l_{suffix}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(f"l_{suffix}").join(spark.table(f"o_{suffix}"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 8_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        load_table(orders, f"{workdir}/x", bucket_by=(8, ["k"]))
