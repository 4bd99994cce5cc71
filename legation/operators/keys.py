"""Keys and functional dependencies of a table, found level by level (Q4).

For a set of columns X the error e(X) is the number of rows beyond one per
class of equal X values. X is a key if e(X) = 0, and X determines A if
e(X) = e(X with A). Classes of one row add nothing to an error, so only the
others are summed. Sets grow by one column per level; sets that hold a key are
not measured, nor those whose error follows from a known dependency. The sets
of a level are measured together by grouping sets, which combine in the map
tasks; the driver receives one number per set. The distinct rows are kept in
the shared folder in small partitions, and a pass measures as many sets as
leave a task a bounded number of classes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.session import shared_dir

SETS_PER_PASS = 32  # grouping sets of one job: bounds how often a row is expanded
CLASSES_PER_TASK = 1 << 20  # classes that a task holds at once; with more rows per partition, those of one set
MOSTLY_DISTINCT = 0.9  # share of distinct rows from which combining them in the map tasks saves nothing


def _counted(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The distinct rows with their copies ``n``, written once, and how many sets a pass may measure."""
    spark, most = df.sparkSession, max(rows, 1)
    shared_dir(spark)  # makes sure a checkpoint folder is set
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-most // CLASSES_PER_TASK), min(shuffled, -(-most * SETS_PER_PASS // CLASSES_PER_TASK)))
    distinct = df.agg(F.approx_count_distinct(F.xxhash64(*df.columns)).alias("n")).first()["n"]
    if distinct >= MOSTLY_DISTINCT * most:  # so that no scan task holds all of its rows
        df = df.repartition(parts, *df.columns)
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.repartition(parts, *df.columns).checkpoint(eager=True)
    return counted, max(1, min(SETS_PER_PASS, CLASSES_PER_TASK * parts // most))


def _errors(counted: DataFrame, sets: list[frozenset[int]], per_pass: int) -> dict[frozenset[int], int]:
    """e(X) of each set; ``counted`` has the columns c0, c1, ... and the copies ``n`` of each row."""
    out = {}
    for i in range(0, len(sets), per_pass):
        some = sets[i : i + per_pass]
        used = sorted(set().union(*some))
        classes = counted.groupingSets([[F.col(f"c{c}") for c in sorted(s)] for s in some], *[F.col(f"c{c}") for c in used]).agg(
            F.grouping_id(*[F.col(f"c{c}") for c in used]).alias("id"), F.sum("n").alias("n")
        )
        rows = classes.where("n > 1").groupBy("id").agg(F.sum(F.col("n") - 1).alias("e")).collect()
        found = {r["id"]: r["e"] for r in rows}
        for s in some:
            # The id has a bit for every column that the set does not hold, the first column highest.
            absent = sum(1 << (len(used) - 1 - at) for at, c in enumerate(used) if c not in s)
            out[s] = found.get(absent, 0)
    return out


def keys_and_dependencies(df: DataFrame, columns: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """Q4: every minimal key and every minimal functional dependency among ``columns``.

    One row each: ``kind`` (``key`` or ``dependency``), ``columns`` (names
    joined by commas, in table order; empty for the empty set) and
    ``determines`` (null for keys). A constant column is determined by the
    empty set; a table of one row or none has the empty set as its key. Nulls
    equal each other, repeated rows leave no key. ``largest`` bounds the
    number of columns on the left. The number of sets can grow with 2 to the
    number of columns.
    """
    names = list(columns or df.columns)
    width, spark = len(names), df.sparkSession
    if width > 60:
        raise ValueError("at most 60 columns: name the ones to look at")
    counted = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    rows = df.count()
    counted, per_pass = _counted(counted, rows)
    errors: dict[frozenset[int], int] = {frozenset(): max(rows - 1, 0)}
    keys: list[frozenset[int]] = []
    found: list[tuple[frozenset[int], int]] = []
    everything = range(width)

    def implied(s: frozenset[int]) -> int | None:
        """e(s) where a known dependency gives it."""
        for left, right in found:
            if right in s and left < s and left <= s - {right}:
                return errors.get(s - {right})
        return None

    def add(left: frozenset[int], right: int) -> None:
        if not any(r == right and other <= left for other, r in found):
            found.append((left, right))

    if errors[frozenset()] == 0:
        keys.append(frozenset())
    top = width if largest is None else min(width, largest + 1)
    for size in range(1, top + 1):
        sets = [s for s in map(frozenset, combinations(everything, size)) if not any(k <= s for k in keys)]
        if not sets:
            break
        open_ = []
        for s in sets:
            known = implied(s)
            if known is None:
                open_.append(s)
            else:
                errors[s] = known
        errors |= _errors(counted, open_, per_pass)
        for s in sets:
            for a in sorted(s):
                if errors.get(s - {a}) == errors[s]:
                    add(s - {a}, a)
        keys += [s for s in sets if errors[s] == 0]
    if largest is not None:
        keys = [k for k in keys if len(k) <= largest]
    for k in keys:
        for a in everything:
            if a not in k:
                add(k, a)
    label = lambda s: ",".join(names[i] for i in sorted(s))
    out = [("key", label(k), None) for k in keys] + [("dependency", label(left), names[right]) for left, right in found]
    return spark.createDataFrame(out, "kind string, columns string, determines string")
