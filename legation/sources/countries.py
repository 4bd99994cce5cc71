"""The country dimension file: typed read, names, key tidying and invariants.

The file is ``;``-separated UTF-8 (a byte-order mark is allowed) with the
generic header ``column1;column2;column3``: a three-letter code, the
country's name and an integer continent code. The continent labels are not
part of the file; pass them to ``decode`` as a mapping or a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from legation.operators.clean import assign_names, normalise_keys
from legation.sources.delimited import read_delimited, read_with_rejects

# Fixed values of the country file: its header names and types in file
# order, the pattern every code follows, and the continent codes that occur.
COUNTRY_FILE_SCHEMA = StructType(
    [
        StructField("column1", StringType(), False),
        StructField("column2", StringType(), False),
        StructField("column3", IntegerType(), False),
    ]
)
CODE_PATTERN = "^[A-Z]{3}$"
CONTINENT_CODES = (2, 3, 4, 5, 6, 7, 8)

# The names this package gives the three columns.
COUNTRY_NAMES = {"column1": "country_code", "column2": "country_name", "column3": "continent_code"}


def read_countries(
    spark: SparkSession, path: str, strict: bool = True, normalise: bool = True
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The country table with meaningful names (and, by default, tidied codes).

    ``strict`` fails on the first malformed row; otherwise returns
    ``(countries, rejects)``. With ``normalise`` codes are trimmed and
    upper-cased and names trimmed (diacritics kept); run ``country_issues``
    with ``normalise=False`` to see the file exactly as written.
    """
    if strict:
        return _tidy(read_delimited(spark, path, COUNTRY_FILE_SCHEMA), normalise)
    good, bad = read_with_rejects(spark, path, COUNTRY_FILE_SCHEMA)
    return _tidy(good, normalise), assign_names(bad, COUNTRY_NAMES)


def _tidy(df: DataFrame, normalise: bool) -> DataFrame:
    named = assign_names(df, COUNTRY_NAMES)
    if not normalise:
        return named
    return normalise_keys(named, codes=["country_code"], names=["country_name"])


def country_issues(
    df: DataFrame,
    continent_codes: Sequence[int] | None = None,
    code: str = "country_code",
    name: str = "country_name",
    continent: str = "continent_code",
) -> DataFrame:
    """Rows breaking the invariants of a country table, one row per problem.

    Checks: the code matches ``^[A-Z]{3}$``, codes and names are unique, no
    field is null, and (when given) the continent code is in
    ``continent_codes``. Output: ``country_code, issue, n`` where ``n`` is
    the number of rows concerned.
    """
    checks = [
        (F.col(code).isNull(), F.lit("missing code")),
        (F.col(name).isNull(), F.lit("missing name")),
        (F.col(continent).isNull(), F.lit("missing continent")),
        (~F.col(code).rlike(CODE_PATTERN), F.lit("code pattern")),
    ]
    if continent_codes is not None:
        allowed = F.col(continent).isin(list(continent_codes))
        checks.append((~allowed, F.lit("unknown continent")))
    issues = F.array(*[F.when(cond, label) for cond, label in checks])
    per_row = (
        df.select(F.col(code).alias("country_code"), F.explode(issues).alias("issue"))
        .where(F.col("issue").isNotNull())
        .groupBy("country_code", "issue")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    repeated_code = (
        df.groupBy(F.col(code).alias("country_code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("country_code").isNotNull())
        .select("country_code", F.lit("repeated code").alias("issue"), "n")
    )
    repeated_name = (
        df.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("country_code"))
        .where(F.col("n") > 1)
        .select("country_code", F.lit("repeated name").alias("issue"), "n")
    )
    return per_row.unionByName(repeated_code).unionByName(repeated_name)
