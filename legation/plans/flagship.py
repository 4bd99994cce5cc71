"""share of one category by state, ranked inside its continent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.functions.exprs import safe_ratio
from legation.operators.joins import enrich
from legation.operators.measures import share_by
from legation.operators.windows import rank_within


def combine_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Re-aggregate ``share_by`` output to coarser ``keys`` (sums the counts)."""
    return df.groupBy(*keys).agg(
        F.sum("n_total").cast("bigint").alias("n_total"),
        F.sum("n_category").cast("bigint").alias("n_category"),
    ).withColumn("share", safe_ratio("n_category", "n_total"))


def category_share_ranking(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    category_col: str,
    category: str,
    dim_key: str,
    name_col: str,
    group_col: str,
    link: tuple[DataFrame, str, str] | None = None,
) -> DataFrame:
    """Share of ``category`` per state, densely ranked (highest first) per group.

    The facts are counted per ``key`` before any join, so the join and the
    window see one row per key. When the facts carry an indirect key (for
    example a person whose state is held in another table), ``link`` is
    ``(table, from_col, to_col)`` mapping ``key`` to the state code; the
    per-key counts are joined to it and summed per state.

    Output: ``group_col, name_col, n_total, n_category, share, rank``. States
    whose code is missing from ``dim`` keep null name and group and have no
    rank: they are no group, and are spread over the window's tasks.
    """
    shares = share_by(fact, key, category_col, category)
    state = key
    if link is not None:
        table, from_col, to_col = link
        shares = enrich(shares, table, key, from_col, [to_col])
        shares = combine_shares(shares, [to_col])
        state = to_col
    named = enrich(shares, dim, state, dim_key, [name_col, group_col])
    alone = F.when(F.col(group_col).isNull(), F.xxhash64(state))
    ranked = rank_within(named.withColumn("__alone", alone), [group_col, "__alone"], "share")
    rank = F.when(F.col(group_col).isNotNull(), F.col("rank")).alias("rank")
    return ranked.select(group_col, name_col, "n_total", "n_category", "share", rank)
