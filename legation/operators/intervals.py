"""Appointments and versions with a beginning and an end.

All three sort rows by group and time into range slices, so a group with a
third of all rows spans many tasks, and carry what a slice needs from the
slices before it: the last version, the furthest end, the running number. Only
a group that crosses a border has something to carry, so the carried table
holds at most one row per slice and is broadcast.

Intervals hold their beginning and not their end; a null end is open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legation.session import shared_dir


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _slices(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """``df`` in range slices (``__slice``) of group and order, kept in the shared folder.

    Every later step sees the same slices, also after an executor loss.
    """
    shared_dir(df.sparkSession, "slices")  # makes sure a checkpoint folder is set
    dealt = df.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *order)
    return dealt.withColumn("__slice", F.spark_partition_id()).checkpoint(eager=True)


def _with_carry(sliced: DataFrame, groups: list[str], of_slice: Column, across: Column) -> DataFrame:
    """``sliced`` with ``__carry``: ``across`` over the ``of_slice`` values of the group's earlier slices.

    ``of_slice`` aggregates a slice's rows of a group, ``across`` combines its
    alias ``__part``; null where the group has no earlier slice.
    """
    parts = sliced.groupBy("__slice", *groups).agg(of_slice.alias("__part"))
    earlier = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__carry", across.over(earlier)).where(F.col("__carry").isNotNull())
    carried = carried.select(
        F.col("__slice").alias("__c_slice"), *[F.col(g).alias(f"__c_{i}") for i, g in enumerate(groups)], "__carry"
    )
    same = [sliced["__slice"] == carried["__c_slice"]]
    same += [sliced[g].eqNullSafe(carried[f"__c_{i}"]) for i, g in enumerate(groups)]
    return sliced.join(F.broadcast(carried), same, "left").select(*[sliced[c] for c in sliced.columns], "__carry")


def validity(versions: DataFrame, key: str | Sequence[str], start: str, end: str = "valid_to") -> DataFrame:
    """Dated versions as intervals: ``end`` is the beginning of the key's next version.

    The last version of a key stays open (null). Versions of a key with one
    beginning end where they begin, all but the last of them in column order.
    Rows with a null beginning are never valid and are left out.
    """
    keys = _names(key)
    # Latest first, so that the next version is the row before.
    order = [F.col(start).desc(), *[F.col(c).desc_nulls_last() for c in versions.columns if c not in (*keys, start)]]
    sliced = _slices(versions.where(F.col(start).isNotNull()), keys, order)
    carried = _with_carry(sliced, keys, F.min(start), F.min("__part"))
    later = Window.partitionBy("__slice", *keys).orderBy(*order)
    return carried.withColumn(end, F.coalesce(F.lag(start).over(later), F.col("__carry"))).drop("__slice", "__carry")


def join_as_of(
    facts: DataFrame,
    versions: DataFrame,
    fact_key: str | Sequence[str],
    version_key: str | Sequence[str],
    at: str,
    start: str,
    end: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every fact with the version of its key that was valid at its time.

    That is the version with the latest ``start`` not after ``at``; if
    ``end`` is given and not after ``at``, the fact falls into a gap. Facts
    without a valid version, a key or a time keep their row with null
    ``columns`` (default: every version column but the key). Where versions of
    a key begin together the largest by the returned columns counts. Facts are
    never multiplied.
    """
    f_keys, v_keys = _names(fact_key), _names(version_key)
    columns = list(columns if columns is not None else [c for c in versions.columns if c not in v_keys])
    groups = [f"__g{i}" for i in range(len(f_keys))]
    until = F.col(end) if end else F.lit(None).cast(versions.schema[start].dataType)
    wanted = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    version = F.struct(F.col(start).alias("at"), wanted.alias("row"), until.alias("until"))
    dated = versions.where(F.col(start).isNotNull())
    for k in v_keys:
        dated = dated.where(F.col(k).isNotNull())
    dated = dated.select(*[F.col(k).alias(g) for k, g in zip(v_keys, groups)], F.col(start).alias("__at"), version.alias("__version"))
    row = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(facts.columns)])
    asked = facts.select(*[F.col(k).alias(g) for k, g in zip(f_keys, groups)], F.col(at).alias("__at"), row.alias("__fact"))
    both = dated.unionByName(asked, allowMissingColumns=True).withColumn("__asks", F.col("__fact").isNotNull())
    # Facts of one key and time are spread by their hash.
    spread = F.when(F.col("__asks"), F.xxhash64("__fact"))
    sliced = _slices(both, groups, [F.col("__at").asc_nulls_first(), F.col("__asks").asc(), spread.asc_nulls_first()])
    carried = _with_carry(sliced, groups, F.max("__version"), F.max("__part"))
    so_far = Window.partitionBy("__slice", *groups).orderBy(F.col("__at").asc_nulls_first(), F.col("__asks").asc())
    found = carried.withColumn("__found", F.coalesce(F.max("__version").over(so_far), F.col("__carry"))).where("__asks")
    valid = F.col("__found.until").isNull() | (F.col("__at") < F.col("__found.until"))
    for g in groups:
        valid = valid & F.col(g).isNotNull()
    valid = valid & F.col("__at").isNotNull()
    return found.select(
        *[F.col(f"__fact.f{i}").alias(c) for i, c in enumerate(facts.columns)],
        *[F.when(valid, F.col(f"__found.row.v{i}")).alias(c) for i, c in enumerate(columns)],
    )


def tenure_spells(df: DataFrame, group: str | Sequence[str], start: str, end: str, name: str = "n_postings") -> DataFrame:
    """Postings that overlap or touch, merged into spells per group.

    Columns: the group, ``spell_start``, ``spell_end`` (null if a posting of
    the spell is open) and the number of postings. Rows without a beginning,
    or that end before they begin, are in no spell. A null group is a group.
    """
    groups = _names(group)
    rows = df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    far = F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end")).alias("__far")
    rows = rows.select(*groups, F.col(start).alias("__start"), far)
    # Repeated postings are one row with a number, so none can fill a task.
    rows = rows.groupBy(*groups, "__start", "__far").agg(F.count(F.lit(1)).alias("__n"))
    order = [F.col("__start").asc(), F.col("__far").asc()]
    sliced = _with_carry(_slices(rows, groups, order), groups, F.max("__far"), F.max("__part"))
    before = Window.partitionBy("__slice", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max("__far").over(before), F.col("__carry"))
    fresh = sliced.withColumn("__reached", reached).drop("__carry")
    begins = F.col("__reached").isNull() | (~F.col("__reached.open") & (F.col("__start") > F.col("__reached.end")))
    fresh = fresh.withColumn("__begin", F.when(begins, F.col("__start"))).drop("__reached")
    # The beginning of the spell so far: the latest row that began one.
    carried = _with_carry(fresh, groups, F.max("__begin"), F.max("__part"))
    here = Window.partitionBy("__slice", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spell = F.greatest(F.max("__begin").over(here), F.col("__carry"))
    merged = carried.withColumn("spell_start", spell).groupBy(*groups, "spell_start").agg(
        F.max("__far").alias("__far"), F.sum("__n").alias(name)
    )
    return merged.select(*groups, "spell_start", F.col("__far.end").alias("spell_end"), name)


def in_post(df: DataFrame, group: str | Sequence[str], start: str, end: str, at: str = "at", name: str = "n_in_post") -> DataFrame:
    """A10: the number in post from every date on which it may change.

    One row per group and date with ``n_begin``, ``n_end`` and the number in
    post from then on. A posting counts from its beginning to before its end;
    a null end never ends. Rows without a beginning, or that end before they
    begin, are left out. A null group is a group.
    """
    groups = _names(group)
    rows = df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    events = rows.select(
        *groups,
        F.inline(F.array(
            F.struct(F.col(start).alias(at), F.lit(1).alias("__b"), F.lit(0).alias("__e")),
            F.struct(F.col(end).alias(at), F.lit(0).alias("__b"), F.lit(1).alias("__e")),
        )),
    ).where(F.col(at).isNotNull())
    # Counted per date first: a hot group is at most one row per date.
    daily = events.groupBy(*groups, at).agg(F.sum("__b").alias("n_begin"), F.sum("__e").alias("n_end"))
    change = F.col("n_begin") - F.col("n_end")
    carried = _with_carry(_slices(daily, groups, [F.col(at).asc()]), groups, F.sum(change), F.sum("__part"))
    here = Window.partitionBy("__slice", *groups).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum(change).over(here) + F.coalesce(F.col("__carry"), F.lit(0))
    return carried.select(*groups, at, "n_begin", "n_end", number.alias(name))
