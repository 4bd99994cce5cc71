"""Versions of a reference table: merge (upsert) and difference.

The merge keeps the new rows and the old rows whose key they do not hold (an
anti join, whose keys Spark broadcasts when they are small, so that a small
update does not move the large table). Differences are one aggregation over
the union of the versions. Columns that only one version has are part of the
result, null for the other version's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_per_key(df: DataFrame, key: str | Sequence[str], version: str) -> DataFrame:
    """The row with the highest ``version`` for each key.

    Ties on ``version`` are broken by the remaining columns, so the result
    does not depend on row order.
    """
    keys = _keys(key)
    payload = [c for c in df.columns if c not in keys and c != version]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in payload])).alias("__best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in payload])


def merge_versions(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Upsert ``new`` into ``old``; where both hold a key, ``new`` wins.

    Keys only in ``old`` are kept; keys only in ``new`` are added. Columns
    are matched by name; those that only one version has are null for rows of
    the other. No row is dropped for repeating a key within its own version
    (``duplicate_keys`` reports such keys). Null keys match each other.
    """
    keys = _keys(key)
    named = new.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    same = [old[k].eqNullSafe(named[f"__k_{k}"]) for k in keys]
    return old.join(named, same, "left_anti").unionByName(new, allowMissingColumns=True)


def _aligned(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both versions with the columns of either, nulls for the absent ones."""
    types = {f.name: f.dataType for f in [*new.schema.fields, *old.schema.fields]}
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]

    def full(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names])

    return full(old), full(new)


def diff_versions(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys added, removed or changed between two versions.

    One row per differing key: ``change`` is ``added``, ``removed``,
    ``changed`` or ``duplicate``, followed by ``old_<c>`` and ``new_<c>`` for
    every non-key column of either version. Nulls compare equal to nulls. A
    key that repeats within a version cannot be paired: it is reported as
    ``duplicate`` with one of its rows (the largest) per version.
    """
    keys = _keys(key)
    old, new = _aligned(old, new)
    payload = [c for c in old.columns if c not in keys]
    side = F.col("__side")

    def tag(df: DataFrame, s: int) -> DataFrame:
        return df.select(
            *keys, F.struct(*[F.col(c) for c in payload]).alias("__v"), F.lit(s).alias("__side")
        )

    both = tag(old, 0).unionByName(tag(new, 1))
    g = both.groupBy(*keys).agg(
        F.max(F.when(side == 0, F.col("__v"))).alias("__old"),
        F.max(F.when(side == 1, F.col("__v"))).alias("__new"),
        F.count_if(side == 0).alias("__n_old"),
        F.count_if(side == 1).alias("__n_new"),
    )
    change = (
        F.when((F.col("__n_old") > 1) | (F.col("__n_new") > 1), F.lit("duplicate"))
        .when(F.col("__n_old") == 0, F.lit("added"))
        .when(F.col("__n_new") == 0, F.lit("removed"))
        .when(~F.col("__old").eqNullSafe(F.col("__new")), F.lit("changed"))
    )
    out = g.withColumn("change", change).where(F.col("change").isNotNull())
    return out.select(
        *keys,
        "change",
        *[F.col(f"__old.{c}").alias(f"old_{c}") for c in payload],
        *[F.col(f"__new.{c}").alias(f"new_{c}") for c in payload],
    )


def whole_row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows present more often in one version than in the other (EXCEPT ALL, both ways).

    One row per distinct differing row: ``side`` is ``old`` when the row has
    more copies in ``old``, ``new`` otherwise, and ``n`` is the surplus of
    copies. The multiplicity stays a number instead of being re-emitted as
    copies, so a row repeated a billion times is still one output row and no
    task has to generate its copies. Nulls compare equal; a column that only
    one version has is null in the other.
    """
    old, new = _aligned(old, new)
    cols = list(old.columns)
    tagged = old.withColumn("__d", F.lit(1)).unionByName(
        new.withColumn("__d", F.lit(-1))
    )
    net = tagged.groupBy(*cols).agg(F.sum("__d").alias("__net")).where(F.col("__net") != 0)
    return net.select(
        *cols,
        F.when(F.col("__net") > 0, F.lit("old")).otherwise(F.lit("new")).alias("side"),
        F.abs(F.col("__net")).cast("bigint").alias("n"),
    )
