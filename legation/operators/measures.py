"""Counts, shares, ratios, subtotals and cross-tabs.

All of these are hash aggregations: Spark computes partial aggregates in
each map task and shuffles only one row per group and task, so a state or
category holding a third of the appointments costs no more shuffle than any
other. Pass ``weight`` when the input was already counted below a join
(one row per group with a count); results are identical.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.functions.exprs import ColumnLike, count_rows, count_where, safe_ratio
from legation.operators.joins import enrich_both


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def count_by(
    df: DataFrame, *keys: str, weight: ColumnLike | None = None, name: str = "n"
) -> DataFrame:
    """A1: number of appointments per combination of ``keys``."""
    return df.groupBy(*keys).agg(count_rows(weight).alias(name))


def share_by(
    df: DataFrame,
    keys: str | Sequence[str],
    category_col: str,
    category: str,
    weight: ColumnLike | None = None,
) -> DataFrame:
    """A2: share of one category inside each group.

    The denominator ``n_total`` counts rows with a non-null category (all
    categories, "other" included); ``n_category`` counts the chosen one;
    ``share`` is their unrounded ratio, null for an empty denominator.
    """
    cat = F.col(category_col)
    return df.groupBy(*_keys(keys)).agg(
        count_where(cat.isNotNull(), weight).alias("n_total"),
        count_where(cat == F.lit(category), weight).alias("n_category"),
    ).withColumn("share", safe_ratio("n_category", "n_total"))


def parity_ratio(
    df: DataFrame,
    keys: str | Sequence[str],
    category_col: str,
    numerator: str,
    denominator: str,
    weight: ColumnLike | None = None,
) -> DataFrame:
    """A3: ratio of two categories inside each group (null when the second is absent)."""
    cat = F.col(category_col)
    return df.groupBy(*_keys(keys)).agg(
        count_where(cat == F.lit(numerator), weight).alias("n_numerator"),
        count_where(cat == F.lit(denominator), weight).alias("n_denominator"),
    ).withColumn("ratio", safe_ratio("n_numerator", "n_denominator"))


def distinct_partners(
    df: DataFrame, key: str, partner: str, approx: bool = False, name: str = "n_partners"
) -> DataFrame:
    """A4: number of distinct partners (e.g. receiving states) per key.

    The exact form de-duplicates (key, partner) pairs in a first aggregation
    that is hash-partitioned on both columns, so one busy key is spread over
    many tasks; the approximate form keeps a HyperLogLog++ sketch per key.
    A key whose partners are all null has 0 of them.
    """
    if approx:
        return df.groupBy(key).agg(F.approx_count_distinct(partner).alias(name))
    pairs = df.select(key, partner).distinct()
    return pairs.groupBy(key).agg(F.count(partner).alias(name))


def rollup_counts(
    df: DataFrame, levels: Sequence[str], weight: ColumnLike | None = None, name: str = "n"
) -> DataFrame:
    """A5: counts along a hierarchy (e.g. continent > country) with subtotals.

    ``g_<level>`` is 1 on rows where that level is rolled up (a subtotal),
    which tells a subtotal apart from a genuine null member. An empty input
    gives no rows, not even a grand total (Spark's rule).
    """
    return df.rollup(*levels).agg(
        count_rows(weight).alias(name),
        *[F.grouping(c).cast("int").alias(f"g_{c}") for c in levels],
    )


def marginals(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    weight: ColumnLike | None = None,
    name: str = "n",
) -> DataFrame:
    """Several marginal count tables in one pass (GROUPING SETS)."""
    cols: list[str] = []
    for s in sets:
        for c in s:
            if c not in cols:
                cols.append(c)
    grouping_sets = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(grouping_sets, *cols).agg(
        count_rows(weight).alias(name),
        *[F.grouping(c).cast("int").alias(f"g_{c}") for c in cols],
    )


def crosstab(
    df: DataFrame,
    row: str | Sequence[str],
    col: str,
    values: Sequence,
    weight: ColumnLike | None = None,
    prefix: str = "",
) -> DataFrame:
    """Categories as columns; absent cells are 0.

    ``values`` are given explicitly: the pivot then runs in one pass and the
    output columns do not depend on the data. ``None`` among the values
    counts the rows whose category is null (column ``None``).
    """
    aggs = [
        count_where(F.col(col).eqNullSafe(F.lit(v)), weight).alias(f"{prefix}{v}") for v in values
    ]
    return df.groupBy(*_keys(row)).agg(*aggs)


def melt(
    df: DataFrame,
    ids: str | Sequence[str],
    values: Sequence[str],
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """A cross-tab back to tidy rows (one row per id and column).

    Column names are quoted, so cross-tab columns named after values with
    dots or dashes work.
    """
    cols = [F.col(f"`{v}`").alias(v) for v in values]
    return df.unpivot([F.col(f"`{i}`") for i in _keys(ids)], cols, variable, value)


def bilateral_matrix(
    fact: DataFrame,
    dim: DataFrame,
    sender: str,
    receiver: str,
    dim_key: str,
    group_col: str,
    weight: ColumnLike | None = None,
    name: str = "n",
) -> DataFrame:
    """Sender-group x receiver-group appointment counts.

    Facts are first counted per (sender, receiver) pair, so the two
    dimension lookups and the final grouping see one row per pair.
    """
    pairs = fact.groupBy(sender, receiver).agg(count_rows(weight).alias("__n"))
    named = enrich_both(pairs, dim, sender, receiver, dim_key, [group_col])
    s, r = f"sender_{group_col}", f"receiver_{group_col}"
    return named.groupBy(s, r).agg(F.sum("__n").cast("bigint").alias(name))

