"""P1-P5 and Q1-Q3 on invented frames."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from legation.operators import (
    assign_names,
    conform_types,
    count_cast_failures,
    decode,
    duplicate_keys,
    filter_appointments,
    normalise_keys,
    profile,
    unmatched_codes,
)


def test_assign_names_refuses_missing_column(spark):
    df = spark.createDataFrame([(1, "a")], "column1 int, column2 string")
    assert assign_names(df, {"column1": "code"}).columns == ["code", "column2"]
    with pytest.raises(ValueError):
        assign_names(df, {"column9": "code"})


def test_conform_types_nulls_and_counts_failures(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "a"), ("x", "3", "b"), (None, "4,5", "c"), ("7", None, "d")],
        "n string, v string, s string",
    )
    schema = StructType([StructField("n", IntegerType()), StructField("v", DoubleType())])
    out = conform_types(df, schema)
    assert rows(out, "s", "n", "v", "_cast_errors") == [
        ("a", 1, 2.5, ""),
        ("b", None, 3.0, "n"),
        ("c", None, None, "v"),
        ("d", 7, None, ""),
    ]
    assert rows(count_cast_failures(df, schema)) == [("n", 1), ("v", 1)]
    comma = df.withColumnRenamed("n", "a,b")
    assert rows(count_cast_failures(comma, StructType([StructField("a,b", IntegerType())]))) == [("a,b", 1)]
    assert count_cast_failures(df, StructType([StructField("s", StringType())])).collect() == []


def test_normalise_keys(spark):
    df = spark.createDataFrame(
        [("  ita ", "  Côte   d'Ivoire "), ("Fra", "Åland\tIslands")], "code string, name string"
    )
    out = normalise_keys(df, codes=["code"], names=["name"])
    assert rows(out) == [("FRA", "Åland Islands"), ("ITA", "Côte d'Ivoire")]


def test_decode_with_mapping_and_frame(spark):
    df = spark.createDataFrame([(1, 2), (2, 9), (3, None)], "id int, code int")
    by_map = decode(df, "code", {2: "Africa", 5: "Europe"}, "continent")
    assert rows(by_map, "id", "continent") == [(1, "Africa"), (2, None), (3, None)]
    labels = spark.createDataFrame([(2, "Africa"), (5, "Europe")], "k int, label string")
    by_frame = decode(df, "code", labels, "continent", "k", "label")
    assert rows(by_frame, "id", "continent") == [(1, "Africa"), (2, None), (3, None)]


def test_filter_appointments(spark):
    df = spark.createDataFrame(
        [
            (1, "W", "head", 2019, dt.datetime(2019, 3, 1)),
            (2, "M", "head", 2020, dt.datetime(2020, 1, 1)),
            (3, "W", "deputy", 2021, dt.datetime(2021, 12, 31)),
            (4, None, "head", 2020, dt.datetime(2020, 6, 1)),
        ],
        "id int, category string, posting string, period int, date timestamp_ntz",
    )
    assert rows(filter_appointments(df, categories=["W"]), "id") == [(1,), (3,)]
    assert rows(filter_appointments(df, postings=["head"], period=(2020, 2021)), "id") == [(2,), (4,)]
    out = filter_appointments(df, dates=("2020-01-01", "2021-01-01"))
    assert rows(out, "id") == [(2,), (4,)]


def test_filter_dates_reach_the_scan(spark, workdir):
    path = f"{workdir}/t"
    spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 1))], "id int, date timestamp_ntz"
    ).write.parquet(path)
    df = filter_appointments(spark.read.parquet(path), dates=("2020-01-01", "2021-01-01"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThan(date" in plan


def test_profile(spark):
    df = spark.createDataFrame(
        [("ABC", 2), ("abc", 2), ("ABD", None), (None, 3), ("ABC", 3)], "code string, group int"
    )
    out = profile(df, key="code", patterns={"code": "^[A-Z]{3}$"})
    got = {r["column_name"]: tuple(r)[1:] for r in out.collect()}
    assert got["code"] == (5, 1, 3, 1)
    assert got["group"] == (5, 1, 2, None)
    assert got["key(code)"] == (5, None, 3, None)
    approx = {r["column_name"]: r["n_distinct"] for r in profile(df, approx=True).collect()}
    assert approx == {"code": 3, "group": 2}


def test_profile_shares_a_pass_for_codes(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, i % 3 if i % 7 else None, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, code string, kind int, same string")
    options = {"key": "id", "patterns": {"code": "^a$", "same": "^x$"}}
    plain = profile(df, **options)
    shared = profile(df, codes=["code", "kind", "same"], **options)
    assert shared.schema == plain.schema
    assert sorted(shared.collect(), key=str) == sorted(plain.collect(), key=str)
    none = profile(df.limit(0), codes=["code", "kind"], **options).collect()
    assert sorted(none, key=str) == sorted(profile(df.limit(0), **options).collect(), key=str)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 1)], "k string, v int")
    assert rows(duplicate_keys(df, ["k", "v"])) == [("A", 1, 2)]
    assert rows(duplicate_keys(df, "k")) == [("A", 3)]
    assert duplicate_keys(df.limit(0), "k").count() == 0


def test_unmatched_codes_reports_orphans_and_nulls(spark):
    fact = spark.createDataFrame(
        [("ITA",), ("XKX",), ("XKX",), (None,), ("FRA",)], "sender string"
    )
    dim = spark.createDataFrame([("ITA", "Italy"), ("FRA", "France")], "code string, name string")
    assert rows(unmatched_codes(fact, dim, "sender", "code")) == sorted(
        [("XKX", 2), (None, 1)], key=lambda r: (r[0] is not None, r)
    )


def test_filter_dates_on_a_date_column(spark, workdir):
    path = f"{workdir}/d"
    spark.createDataFrame(
        [(1, dt.date(2019, 12, 31)), (2, dt.date(2020, 1, 1)), (3, dt.date(2021, 1, 1))], "id int, day date"
    ).write.parquet(path)
    df = filter_appointments(spark.read.parquet(path), dates=("2020-01-01", "2021-01-01"), date_col="day")
    assert rows(df, "id") == [(2,)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2020-01-01)" in plan


def test_conform_types_with_date_format(spark):
    from pyspark.sql.types import DateType

    df = spark.createDataFrame([("31/12/2020",), ("2020-12-31",), (None,)], "d string")
    out = conform_types(df, StructType([StructField("d", DateType())]), formats={"d": "dd/MM/yyyy"})
    assert rows(out) == [(None, ""), (None, "d"), (dt.date(2020, 12, 31), "")]


def test_conform_types_with_timestamp_format(spark):
    from pyspark.sql.types import TimestampNTZType

    df = spark.createDataFrame([("31/12/2020 10:30",), ("bad",)], "t string")
    schema = StructType([StructField("t", TimestampNTZType())])
    out = conform_types(df, schema, formats={"t": "dd/MM/yyyy HH:mm"})
    assert rows(out) == [(None, "t"), (dt.datetime(2020, 12, 31, 10, 30), "")]


def test_normalise_keys_no_break_space(spark):
    df = spark.createDataFrame([(" ita ", "Saint  Barthélemy ")], "code string, name string")
    assert rows(normalise_keys(df, codes=["code"], names=["name"])) == [("ITA", "Saint Barthélemy")]
