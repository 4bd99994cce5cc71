"""Counts kept up to date from version differences.

A count table holds signed counts per combination of keys, one partition per
batch of changes. A batch replaces its own partition, so replaying one changes
nothing and a corrected one takes the place of the first. Reading adds the
batches up; folding writes their sum as a base, behind which batches no longer
count. Facts are never read again: work follows the changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legation.sources.tables import load_table, read_table

_BASE, _BATCH = "is_base", "batch"


def signed_changes(changes: DataFrame, name: str = "n") -> DataFrame:
    """The rows of ``whole_row_changes`` with one signed count: copies added, or lost (negative)."""
    sign = F.when(F.col("side") == "new", F.col("n")).otherwise(-F.col("n"))
    return changes.withColumn(name, sign.cast("bigint")).drop(*{"side", "n"} - {name})


def _write(counts: DataFrame, path: str, keys: list[str], batch: int, base: bool, name: str) -> None:
    # A row that counts nothing marks a batch without changes, so that it still replaces an earlier form.
    types = dict(zip(counts.columns, (f.dataType for f in counts.schema.fields)))
    mark = counts.sparkSession.range(1).select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], F.lit(0).cast("bigint").alias(name))
    rows = counts.unionByName(mark).withColumn(_BASE, F.lit(base)).withColumn(_BATCH, F.lit(batch).cast("bigint"))
    load_table(rows, path, partition_by=[_BASE, _BATCH])


def record_changes(changes: DataFrame, path: str, keys: str | Sequence[str], batch: int, name: str = "n") -> None:
    """Count signed ``changes`` (rows added minus rows lost in ``name``) as batch number ``batch`` of the table.

    The first batch of a table holds the whole first version. Batches may
    arrive in any order and repeatedly; their sum counts. One that is folded
    into a base already changes nothing. Null keys are a group; a null count
    counts nothing.
    """
    groups = [keys] if isinstance(keys, str) else list(keys)
    if batch < 0 or {_BASE, _BATCH} & {*groups, name}:
        raise ValueError(f"batch is 0 or more, and no key is named {_BASE} or {_BATCH}")
    counts = changes.groupBy(*groups).agg(F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name))
    _write(counts.where(F.col(name) != 0), path, groups, batch, False, name)


def _valid(spark: SparkSession, path: str, upto: int | None, fold: bool) -> DataFrame:
    """The partitions that count: the last base (before ``upto`` when folding) and the batches after it."""
    table = read_table(spark, path).withColumn(_BATCH, F.col(_BATCH).cast("bigint")).withColumn(_BASE, F.col(_BASE).cast("boolean"))
    if upto is not None:
        table = table.where((F.col(_BATCH) < upto) | ((F.col(_BATCH) == upto) & ~F.col(_BASE)) if fold else F.col(_BATCH) <= upto)
    last = table.where(_BASE).agg(F.max(_BATCH)).first()[0]
    if last is None:
        return table
    return table.where(F.col(_BASE) & (F.col(_BATCH) == last) | ~F.col(_BASE) & (F.col(_BATCH) > last))


def _summed(rows: DataFrame, groups: list[str], name: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.sum(name).cast("bigint").alias(name)).where(F.col(name) != 0)


def maintained_counts(spark: SparkSession, path: str, keys: str | Sequence[str], upto: int | None = None, name: str = "n") -> DataFrame:
    """The counts per ``keys`` after all batches, or after batch ``upto``; groups that count 0 have no row.

    ``keys`` may be some of the recorded ones. The result serves the measures
    as pre-counted input (``weight=name``): A5's subtotals, A2's shares.
    ``upto`` has to be no earlier than the last base.
    """
    return _summed(_valid(spark, path, upto, fold=False), [keys] if isinstance(keys, str) else list(keys), name)


def fold_batches(spark: SparkSession, path: str, keys: str | Sequence[str], upto: int, name: str = "n") -> None:
    """Write the sum of all batches up to ``upto`` as a base; ``keys`` are all recorded ones.

    Folding anew gives the same base. Partitions behind a base may be deleted
    once no reader uses them, but not before it is folded again.
    """
    groups = [keys] if isinstance(keys, str) else list(keys)
    _write(_summed(_valid(spark, path, upto, fold=True), groups, name), path, groups, upto, True, name)
