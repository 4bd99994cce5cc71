"""Shares of a parent, rankings, top-n, period changes and top-k.

These run on counts that were already aggregated per state (or per state and
period), so a window partition holds at most the members of one continent.
Nothing here uses a window without a partition key: grand totals come from
a scalar subquery, parent totals from an aggregation joined back, and
period changes from a shift-and-group pass, so no step funnels all rows
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from legation.functions.exprs import safe_ratio
from legation.session import shared_dir


def _cols(c: str | Sequence[str] | None) -> list[str]:
    if c is None:
        return []
    return [c] if isinstance(c, str) else list(c)


def _order(by: Sequence[str], ascending: bool, tie_break: Sequence[str]) -> list[Column]:
    first = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in by]
    return first + [F.col(c).asc_nulls_last() for c in tie_break]


def share_of_total(
    df: DataFrame,
    value: str,
    parent: str | Sequence[str] | None = None,
    name: str = "share",
) -> DataFrame:
    """Each row's ``value`` as a part of the grand total or of its parent.

    The parent totals are aggregated separately and joined back on the
    parent key (null-safe), so a parent with very many members is spread
    over tasks like any other join key; the grand total is a scalar
    subquery evaluated once.
    """
    parents = _cols(parent)
    if not parents:
        total = df.select(F.sum(F.col(value))).scalar()
        return df.withColumn(name, safe_ratio(F.col(value), total))
    totals = df.groupBy(*parents).agg(F.sum(value).alias("__parent_total"))
    totals = totals.select(
        *[F.col(p).alias(f"__p_{p}") for p in parents], "__parent_total"
    )
    cond = [df[p].eqNullSafe(totals[f"__p_{p}"]) for p in parents]
    joined = df.join(totals, cond, "left")
    return joined.withColumn(name, safe_ratio(F.col(value), F.col("__parent_total"))).drop(
        "__parent_total", *[f"__p_{p}" for p in parents]
    )


def rank_within(
    df: DataFrame,
    partition: str | Sequence[str],
    by: str | Sequence[str],
    ascending: bool = False,
    name: str = "rank",
    large_groups: bool = False,
) -> DataFrame:
    """Rank inside each partition; equal values share a rank (dense).

    The default is a window per partition, which sorts each group inside one
    task: right for aggregated rows such as states within a continent. With
    ``large_groups`` the rank is computed without ever holding a group in
    one task (see ``_dense_rank_split``); that path runs a checkpoint job
    when called.
    """
    parts, keys = _cols(partition), _cols(by)
    if large_groups:
        return _dense_rank_split(df, parts, keys, ascending, name)
    w = Window.partitionBy(*parts).orderBy(*_order(keys, ascending, []))
    return df.withColumn(name, F.dense_rank().over(w).cast("int"))


def _dense_rank_split(
    df: DataFrame, parts: list[str], by: list[str], ascending: bool, name: str
) -> DataFrame:
    """Dense rank by range slices: no group is ever held by one task.

    1. The distinct (partition, value) pairs are taken (map-side
       de-duplication collapses repeated values of a hot group).
    2. They are range-partitioned in rank order, so one large group spans
       many consecutive slices, and checkpointed to the shared checkpoint
       folder: every later step sees the same slices, also after an
       executor loss.
    3. Inside a slice each group gets a local dense rank; the number of
       distinct values per (group, slice) gives, summed over the earlier
       slices of the group, the offset to add. That sum runs over at most
       one row per slice.
    4. The ranks are joined back to ``df`` on (partition, value), null-safe.
    """
    shared_dir(df.sparkSession, "rank")  # makes sure a checkpoint folder is set
    df = df.checkpoint(eager=True)  # computed once, read for the slices and for the join back
    order = [F.col(p).asc_nulls_first() for p in parts] + _order(by, ascending, [])
    values = df.select(*parts, *by).distinct()
    sliced = (
        values.repartitionByRange(*order)
        .withColumn("__slice", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    local_w = Window.partitionBy("__slice", *parts).orderBy(*_order(by, ascending, []))
    local = sliced.withColumn("__local", F.dense_rank().over(local_w))
    sizes = sliced.groupBy("__slice", *parts).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*parts).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.select(
        F.col("__slice").alias("__o_slice"), *[F.col(p).alias(f"__o_{p}") for p in parts], "__offset"
    )
    cond = [local["__slice"] == offsets["__o_slice"]]
    cond += [local[p].eqNullSafe(offsets[f"__o_{p}"]) for p in parts]
    ranked = local.join(offsets, cond).select(
        *[F.col(p).alias(f"__r_{p}") for p in parts + by],
        (F.col("__local") + F.col("__offset")).cast("int").alias(name),
    )
    back = [df[c].eqNullSafe(ranked[f"__r_{c}"]) for c in parts + by]
    return df.join(ranked, back, "left").drop(*[f"__r_{c}" for c in parts + by])


def _row_number_split(df: DataFrame, parts: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers per group by range slices, so that a group spans many tasks.

    The rows are range-partitioned in (group, order), numbered inside their
    slice, and moved up by the rows that the group has in earlier slices.
    """
    shared_dir(df.sparkSession, "top-n")  # makes sure a checkpoint folder is set
    groups = [F.col(p).asc_nulls_first() for p in parts]
    sliced = df.repartitionByRange(*groups, *order).withColumn("__slice", F.spark_partition_id()).checkpoint(eager=True)
    local = sliced.withColumn("__local", F.row_number().over(Window.partitionBy("__slice", *parts).orderBy(*order)))
    sizes = sliced.groupBy("__slice", *parts).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*parts).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__slice").alias("__o_slice"),
        *[F.col(p).alias(f"__o_{p}") for p in parts],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    cond = [local["__slice"] == offsets["__o_slice"]] + [local[p].eqNullSafe(offsets[f"__o_{p}"]) for p in parts]
    number = (F.col("__local") + F.col("__offset")).cast("int").alias(name)
    return local.join(offsets, cond).select(*[local[c] for c in df.columns], number)


def top_n_per_group(
    df: DataFrame,
    partition: str | Sequence[str],
    by: str | Sequence[str],
    n: int,
    tie_break: str | Sequence[str],
    ascending: bool = False,
    name: str = "position",
) -> DataFrame:
    """The first ``n`` rows of each partition in a total order.

    ``tie_break`` must make the order total so the kept rows do not depend
    on task timing. Spark plans the filter as a ``WindowGroupLimit`` that
    already keeps only ``n`` rows per group in each map task (for ``n`` up
    to ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default),
    so even a group holding a third of all rows reaches the final window as
    ``n`` rows per map task. For a larger ``n`` the rows are numbered by range
    slices (see ``_row_number_split``, which runs a checkpoint job when
    called), so no task holds a whole group either way.
    """
    tie = _cols(tie_break)
    if not tie:
        raise ValueError("top_n_per_group needs a tie_break column")
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit:
        return _row_number_split(df, _cols(partition), _order(_cols(by), ascending, tie), name).where(F.col(name) <= n)
    w = Window.partitionBy(*_cols(partition)).orderBy(*_order(_cols(by), ascending, tie))
    ranked = df.withColumn(name, F.row_number().over(w).cast("int"))
    return ranked.where(F.col(name) <= n)


def change_over(
    df: DataFrame,
    period: str,
    measure: str,
    partition: str | Sequence[str] | None = None,
    step: int = 1,
    previous: str = "previous",
    change: str = "change",
) -> DataFrame:
    """``measure`` against its value ``step`` periods earlier.

    ``df`` has one row per (partition, period). Each row is emitted twice in
    one pass (``explode``): once at its own period carrying the row, once at
    ``period + step`` carrying its measure as the earlier value; grouping by
    (partition, period) then pairs every row with its predecessor. This reads
    ``df`` once, needs no join and no window, and a missing earlier period
    gives null rather than a comparison with an older, non-adjacent one.
    Null partition keys form a group of their own; a null period has no
    predecessor. A repeated (partition, period) fails the query: no choice
    between its rows would be right.
    """
    keys = _cols(partition)
    others = [c for c in df.columns if c not in keys and c != period]
    fields = {f.name: f.dataType for f in df.schema.fields}
    row_type = StructType([StructField(c, fields[c], True) for c in others])
    here = F.struct(
        F.col(period).alias("p"),
        F.struct(*[F.col(c) for c in others]).alias("row"),
        F.lit(None).cast(fields[measure]).alias("prev"),
    )
    later = F.struct(
        (F.col(period) + F.lit(step)).alias("p"),
        F.lit(None).cast(row_type).alias("row"),
        F.when(F.col(period).isNotNull(), F.col(measure)).alias("prev"),
    )
    shifted = df.select(*keys, F.explode(F.array(here, later)).alias("__e"))
    paired = shifted.groupBy(*keys, F.col("__e.p").alias("__p")).agg(
        F.max("__e.row").alias("__row"),
        F.max("__e.prev").alias(previous),
        F.count("__e.row").alias("__rows"),
    )
    repeated = F.raise_error(F.lit("change_over: more than one row for a partition and period"))
    once = F.when(F.col("__rows") > 1, repeated.cast("boolean")).otherwise(F.col("__rows") == 1)
    present = paired.where(once)
    cols = [
        F.col("__p").alias(c) if c == period else F.col(c) if c in keys else F.col(f"__row.{c}").alias(c)
        for c in df.columns
    ]
    out = present.select(*cols, F.col(previous))
    return out.withColumn(change, F.col(measure) - F.col(previous))


def top_k(
    df: DataFrame,
    by: str | Sequence[str],
    k: int,
    tie_break: str | Sequence[str],
    ascending: bool = False,
) -> DataFrame:
    """L1: the overall first ``k`` rows in a total order (a top-k report).

    Planned as ``TakeOrderedAndProject``: every task keeps its own best
    ``k`` and only those are merged.
    """
    tie = _cols(tie_break)
    if not tie:
        raise ValueError("top_k needs a tie_break column")
    return df.orderBy(*_order(_cols(by), ascending, tie)).limit(k)
