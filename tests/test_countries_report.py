"""The country file (invented rows of its shape) and the report feeds."""

from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from legation.plans.report import representation_report
from legation.sources import CONTINENT_CODES, country_issues, read_countries, read_delimited


def _write(path: str, lines: list[str]) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(b"\xef\xbb\xbf" + ("\n".join(lines) + "\n").encode("utf-8"))
    return path


COUNTRIES = [
    "column1;column2;column3",
    "AAA;Alpha, Republic of;2",
    "BBB;Bétaland;5",
    "CCC;Côte d'Gamma;2",
    "DDD;Delta (Islands);6",
    "EEE;Epsilon-Land;5",
]


def test_read_countries_names_and_types(spark, workdir):
    df = read_countries(spark, _write(f"{workdir}/c.csv", COUNTRIES))
    assert df.columns == ["country_code", "country_name", "continent_code"]
    assert df.schema["continent_code"].dataType == IntegerType()
    assert ("BBB", "Bétaland", 5) in rows(df)
    assert country_issues(df, CONTINENT_CODES).count() == 0


def test_country_defects(spark, workdir):
    lines = COUNTRIES + ["FFF;Phi;x", "GGG;Gamma", "AAA;Alpha again;2", "hhh;Eta;4", "III;Iota;1"]
    good, bad = read_countries(spark, _write(f"{workdir}/d.csv", lines), strict=False, normalise=False)
    assert rows(bad, "country_code") == [("FFF",), ("GGG",)]
    issues = rows(country_issues(good, CONTINENT_CODES))
    assert issues == [
        ("AAA", "repeated code", 2),
        ("III", "unknown continent", 1),
        ("hhh", "code pattern", 1),
    ]
    tidy, _ = read_countries(spark, f"{workdir}/d.csv", strict=False)
    assert "hhh" not in [r[0] for r in rows(tidy, "country_code")]


@pytest.fixture
def appointments(spark):
    data = [
        # sender, receiver, category, posting, period
        ("AAA", "BBB", "W", "head", 2020),
        ("AAA", "CCC", "M", "head", 2020),
        ("AAA", "BBB", "W", "deputy", 2021),
        ("BBB", "AAA", "M", "head", 2020),
        ("BBB", None, "O", "head", 2021),
        ("CCC", "AAA", "W", "head", 2021),
        ("XKX", "AAA", "W", "head", 2021),
    ]
    return spark.createDataFrame(
        data, "sender_code string, receiver_code string, category string, posting string, period int"
    )


def test_report_writes_feeds(spark, workdir, appointments):
    countries = read_countries(spark, _write(f"{workdir}/c.csv", COUNTRIES))
    paths = representation_report(
        f"{workdir}/feeds", appointments, countries, "W", ["W", "M", "O"], other="M", period_col="period"
    )
    assert set(paths) == {
        "share_by_state",
        "counts_with_subtotals",
        "state_by_period",
        "unmatched_senders",
        "parity_by_state",
        "category_by_posting",
        "continent_matrix",
        "share_by_period",
    }
    share_schema = StructType(
        [
            StructField("continent_code", IntegerType()),
            StructField("country_name", StringType()),
            StructField("n_total", LongType()),
            StructField("n_category", LongType()),
            StructField("share", StringType()),
            StructField("rank", IntegerType()),
        ]
    )
    shares = {r["country_name"]: r for r in read_delimited(spark, paths["share_by_state"], share_schema).collect()}
    assert shares["Alpha, Republic of"]["n_category"] == 2 and shares["Alpha, Republic of"]["rank"] == 2
    assert shares["Côte d'Gamma"]["rank"] == 1
    matrix_schema = "sender_continent_code int, receiver_continent_code int, n bigint"
    matrix = rows(spark.read.csv(paths["continent_matrix"], sep=";", header=True, schema=matrix_schema))
    assert matrix == [(None, 2, 1), (2, 2, 2), (2, 5, 2), (5, 2, 1)]
    grid_schema = "country_name string, period int, n bigint"
    grid = rows(spark.read.csv(paths["state_by_period"], sep=";", header=True, schema=grid_schema))
    assert len(grid) == 5 * 2 + 1  # five countries x periods 2020..2021, and the unmatched sender
    assert sum(n for _, _, n in grid) == appointments.count()
    assert ("Alpha, Republic of", 2020, 2) in grid and ("Delta (Islands)", 2021, 0) in grid
    sub_schema = "continent_code int, country_name string, n bigint, g_continent_code int, g_country_name int"
    subtotals = rows(spark.read.csv(paths["counts_with_subtotals"], sep=";", header=True, schema=sub_schema))
    assert (None, None, 7, 1, 1) in subtotals and (2, None, 4, 0, 1) in subtotals


def test_feeds_without_optional_columns(spark, workdir, appointments):
    from legation.plans.report import representation_feeds

    countries = read_countries(spark, _write(f"{workdir}/c.csv", COUNTRIES))
    feeds = representation_feeds(
        appointments.drop("receiver_code", "posting"), countries, "W", ["W", "M"],
        receiver=None, posting_col=None,
    )
    assert set(feeds) == {"share_by_state", "counts_with_subtotals", "unmatched_senders"}
    assert rows(feeds["unmatched_senders"]) == [("XKX", 1)]
