"""Confidence intervals for shares and ratios by a Poisson bootstrap.

Each replicate draws every row a Poisson(1) number of times. The draw is read
from a hash of the row's key, so it does not depend on where or how often the
row is processed, and replicates need no second pass: each row adds its draws
to the sums of its group, which combine in the map tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.functions.exprs import safe_ratio

PER_HASH = 8  # an MD5 has 32 hex digits, four for each replicate
_SPAN = 1 << 16


def poisson_thresholds() -> list[int]:
    """A draw u of 0 to 65535 counts as many rows as thresholds are at most u."""
    out, total, k = [], 0.0, 0
    while (bound := math.floor(_SPAN * (total := total + math.exp(-1) / math.factorial(k)))) < _SPAN - 1:
        out.append(bound)
        k += 1
    return out


def _draw(hashed: Column, at: int) -> Column:
    u = F.substr(hashed, F.lit(4 * at + 1), F.lit(4))  # hex digits of one width compare as their numbers do
    bounds = poisson_thresholds()
    weight = F.when(u < f"{bounds[0]:04x}", 0)
    for times, bound in enumerate(bounds[1:], 1):
        weight = weight.when(u < f"{bound:04x}", times)
    return weight.otherwise(len(bounds))


def share_intervals(
    df: DataFrame,
    keys: str | Sequence[str],
    category_col: str,
    category: str,
    row_key: str | Sequence[str],
    against: str | None = None,
    replicates: int = 200,
    level: float = 0.95,
) -> DataFrame:
    """Share of a category per group (or its ratio to ``against``) with a percentile interval.

    ``n_denominator`` and ``n_numerator`` count as in ``share_by`` (or
    ``parity_ratio`` where ``against`` is given), ``value`` is their ratio,
    ``low`` and ``high`` are the replicates' values at the ranks
    ceil(m (1 - level) / 2) and ceil(m (1 + level) / 2) of the m =
    ``n_replicates`` that have one. A replicate whose denominator is 0 has
    none; a group without a denominator has nulls. ``row_key`` names the
    drawn unit: rows with equal keys are drawn together (name the state to
    draw whole states), as are rows whose key is null. Reruns agree.
    ``replicates`` is a multiple of 8.
    """
    if replicates < PER_HASH or replicates % PER_HASH or not 0 < level < 1:
        raise ValueError("replicates is a multiple of 8 and level between 0 and 1")
    groups = [keys] if isinstance(keys, str) else list(keys)
    unit = [row_key] if isinstance(row_key, str) else list(row_key)
    named = [f"__g{i}" for i in range(len(groups))]
    cat = F.col(category_col)
    counted = cat.isNotNull() if against is None else cat == F.lit(against)
    rows = df.select(
        *[F.col(g).alias(n) for g, n in zip(groups, named)],
        F.concat_ws("|", *[F.coalesce(F.col(u).cast("string"), F.lit("")) for u in unit]).alias("__unit"),
        F.coalesce(counted, F.lit(False)).alias("__den"),
        F.coalesce(cat == F.lit(category), F.lit(False)).alias("__num"),
    )
    blocks = F.explode(F.sequence(F.lit(0), F.lit(replicates // PER_HASH - 1))).alias("__block")
    rows = rows.select("*", blocks)
    rows = rows.withColumn("__hash", F.md5(F.concat("__unit", F.lit(":"), F.col("__block").cast("string"))))
    rows = rows.select("*", *[_draw(F.col("__hash"), j).alias(f"__w{j}") for j in range(PER_HASH)])

    def total(weight: Column, where: str) -> Column:
        return F.sum(F.when(F.col(where), weight).otherwise(0)).cast("bigint")

    sums = rows.groupBy(*named, "__block").agg(
        total(F.lit(1), "__den").alias("n_denominator"),
        total(F.lit(1), "__num").alias("n_numerator"),
        *[total(F.col(f"__w{j}"), s).alias(f"{s}{j}") for j in range(PER_HASH) for s in ("__den", "__num")],
    )
    values = F.array(*[safe_ratio(f"__num{j}", f"__den{j}") for j in range(PER_HASH)])
    out = sums.groupBy(*named).agg(
        F.max("n_denominator").alias("n_denominator"),
        F.max("n_numerator").alias("n_numerator"),
        F.sort_array(F.filter(F.flatten(F.collect_list(values)), lambda v: v.isNotNull())).alias("__values"),  # ``replicates`` at most
    )
    m = F.size("__values")

    def at(q: float) -> Column:
        return F.when(m > 0, F.element_at("__values", F.greatest(F.lit(1), F.ceil(m * F.lit(q)).cast("int"))))

    return out.select(
        *[F.col(n).alias(g) for g, n in zip(groups, named)],
        "n_denominator", "n_numerator", safe_ratio("n_numerator", "n_denominator").alias("value"),
        at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"), m.alias("n_replicates"),
    )
