"""Joins between appointments and the country dimension.

The country dimension is small (a few hundred rows) and is broadcast after a
check of its estimated size; facts never shuffle to meet it. Semi and anti joins
de-duplicate the fact keys first, so a key that holds a third of the facts
reaches the join as one row per map task instead of a skewed partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, bounded_broadcast


def _dim_side(
    dim: DataFrame,
    dim_key: str,
    columns: Sequence[str] | None,
    prefix: str,
    max_bytes: int | None,
) -> tuple[DataFrame, str]:
    cols = [c for c in (columns or dim.columns) if c != dim_key]
    key_alias = f"__{prefix}key"
    side = dim.select(
        F.col(dim_key).alias(key_alias),
        *[F.col(c).alias(prefix + c) for c in cols],
    )
    return bounded_broadcast(side, max_bytes), key_alias


def enrich(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str | None = None,
    columns: Sequence[str] | None = None,
    prefix: str = "",
    how: str = "left",
    max_bytes: int | None = DEFAULT_MAX_BROADCAST_BYTES,
    collation: str | None = None,
) -> DataFrame:
    """Add dimension columns to each fact row by an equi join.

    ``how="left"`` keeps facts whose code has no dimension row (their new
    columns are null; report them with ``unmatched_codes``). The dimension
    key must be unique, or facts multiply. Keys compare exactly; pass
    ``collation="UTF8_LCASE"`` for a case-blind match of string codes.
    ``max_bytes`` bounds the estimated size up to which ``dim`` is broadcast;
    ``None`` leaves the choice to Spark (see ``plans.sizing``).
    """
    side, key_alias = _dim_side(dim, dim_key or key, columns, prefix, max_bytes)
    left, right = fact[key], side[key_alias]
    if collation:
        left, right = F.collate(left, collation), F.collate(right, collation)
    joined = fact.join(side, left == right, how)
    return joined.drop(key_alias)


def enrich_both(
    fact: DataFrame,
    dim: DataFrame,
    sender: str,
    receiver: str,
    dim_key: str,
    columns: Sequence[str] | None = None,
    prefixes: tuple[str, str] = ("sender_", "receiver_"),
    how: str = "left",
    max_bytes: int | None = DEFAULT_MAX_BROADCAST_BYTES,
    collation: str | None = None,
) -> DataFrame:
    """The same dimension joined twice, for the sending and receiving side.

    Each role gets its own prefixed copy of ``columns``. Aggregate the facts
    to (sender, receiver) first when only counts are wanted: the lookups then
    touch one row per pair instead of one per appointment.
    """
    out = enrich(fact, dim, sender, dim_key, columns, prefixes[0], how, max_bytes, collation)
    return enrich(out, dim, receiver, dim_key, columns, prefixes[1], how, max_bytes, collation)


def _fact_keys(fact: DataFrame, fact_key: str, where: Column | str | None) -> DataFrame:
    if where is not None:
        fact = fact.where(where)
    # Partial aggregation de-duplicates map-side, before the shuffle.
    return fact.select(F.col(fact_key).alias("__member_key")).distinct()


def active_members(
    dim: DataFrame,
    fact: DataFrame,
    key: str,
    fact_key: str | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """Dimension rows with at least one matching fact (EXISTS)."""
    keys = _fact_keys(fact, fact_key or key, where)
    return dim.join(keys, dim[key] == keys["__member_key"], "left_semi")


def inactive_members(
    dim: DataFrame,
    fact: DataFrame,
    key: str,
    fact_key: str | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """Dimension rows with no matching fact (NOT EXISTS)."""
    keys = _fact_keys(fact, fact_key or key, where)
    return dim.join(keys, dim[key] == keys["__member_key"], "left_anti")


Domain = DataFrame | Sequence | Column


def complete(
    counts: DataFrame,
    keys: Mapping[str, Domain],
    measures: Sequence[str],
    fill: int | float = 0,
) -> DataFrame:
    """Every combination of the key domains, with absent measures = ``fill``.

    ``keys`` maps each key column, in order, to its domain:

    * the first key may take a DataFrame holding that column (for example the
      dimension, so members without any fact still appear); it is
      de-duplicated;
    * every key may take an explicit list of values or an array-valued
      Column (for example ``F.sequence(lo, hi)`` over scalar subqueries).

    The grid is generated with ``explode`` over the bounded value lists; the
    observed counts are then joined to it on all keys (null-safe, so a null
    member of a domain still finds its counts). Counts whose keys lie outside
    the domains are kept as rows of their own, so every measure's total is
    that of ``counts``; an axis made of a sequence grows with its bounds, so
    check the bounds of a period first.
    """
    names = list(keys)
    first = names[0]
    base_dom = keys[first]
    if isinstance(base_dom, DataFrame):
        grid = base_dom.select(first).distinct()
    else:
        grid = counts.sparkSession.range(1).select(
            F.explode(_as_array(base_dom)).alias(first)
        )
    for name in names[1:]:
        dom = keys[name]
        if isinstance(dom, DataFrame):
            raise ValueError("only the first key may take a DataFrame domain")
        grid = grid.withColumn(name, F.explode(_as_array(dom)))
    grid = grid.withColumn("__in", F.lit(True))
    observed = counts.select(*[F.col(k).alias(f"__c_{k}") for k in names], *measures)
    cond = [grid[k].eqNullSafe(observed[f"__c_{k}"]) for k in names]
    joined = grid.join(observed, cond, "full_outer")
    inside = grid["__in"].isNotNull()
    return joined.select(
        *[F.when(inside, grid[k]).otherwise(observed[f"__c_{k}"]).alias(k) for k in names], *[F.coalesce(F.col(m), F.lit(fill)).alias(m) for m in measures]
    )


def _as_array(dom: Sequence | Column) -> Column:
    if isinstance(dom, Column):
        return dom
    return F.array(*[F.lit(v) for v in dom])
