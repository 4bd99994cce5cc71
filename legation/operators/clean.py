"""Naming, typing, key normalisation, decoding, filtering and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legation.functions.exprs import cast_failed, normalised_code, normalised_name, to_type
from legation.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, bounded_broadcast


def assign_names(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; every source name must exist (Spark would ignore a typo)."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def conform_types(
    df: DataFrame,
    schema: StructType,
    errors: str = "_cast_errors",
    formats: Mapping[str, str] | None = None,
) -> DataFrame:
    """Convert columns to the types of ``schema`` in one projection.

    A value that does not convert becomes null, and its column name is
    listed in the text column ``errors`` (names joined by commas, empty
    when the row converted cleanly). Columns not in ``schema``, and columns
    already of the wanted type, pass through unchanged. ``formats`` maps a
    date or timestamp column to its pattern (e.g. ``dd/MM/yyyy``). Everything
    stays in one generated-code projection (no higher-order functions).
    """
    formats = dict(formats or {})
    current = {f.name: f.dataType for f in df.schema.fields}
    typed: dict[str, Column] = {}
    failures = []
    for field in schema.fields:
        if current.get(field.name) == field.dataType:
            continue
        raw = F.col(field.name)
        value = to_type(raw, field.dataType, formats.get(field.name))
        typed[field.name] = value
        failures.append(F.when(cast_failed(raw, value), F.lit(field.name)))
    out = [typed[c].alias(c) if c in typed else F.col(c) for c in df.columns]
    return df.select(*out, F.concat_ws(",", *failures).alias(errors))


def count_cast_failures(df: DataFrame, schema: StructType, formats: dict[str, str] | None = None) -> DataFrame:
    """``column_name, n_failed``: values that ``conform_types`` could not convert, per column that has any.

    One aggregate per column in a single pass, whose result is one row until
    it is unfolded; the columns' names are never part of a text.
    """
    formats = formats or {}
    current = {f.name: f.dataType for f in df.schema.fields}
    fields = [f for f in schema.fields if current.get(f.name) != f.dataType]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, n_failed long")
    counts = [
        F.count_if(cast_failed(_quoted(f.name), to_type(_quoted(f.name), f.dataType, formats.get(f.name)))).alias(f"n{i}")
        for i, f in enumerate(fields)
    ]
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("n_failed")) for i, f in enumerate(fields)]
    return df.agg(*counts).select(F.inline(F.array(*rows))).where(F.col("n_failed") > 0)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_keys(df: DataFrame, codes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Tidy join keys before matching.

    ``codes`` are trimmed, inner blanks collapsed and upper-cased; ``names``
    are only trimmed and collapsed, so diacritics and case are kept.
    """
    return df.withColumns(
        {**{c: normalised_code(c) for c in codes}, **{c: normalised_name(c) for c in names}}
    )


def decode(
    df: DataFrame,
    col: str,
    labels: DataFrame | Mapping,
    label: str,
    label_key: str | None = None,
    label_col: str | None = None,
    max_bytes: int | None = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add column ``label`` holding the label of the code in ``col``.

    ``labels`` is either a small mapping (compiled into a literal map, no
    join) or a DataFrame of ``label_key`` -> ``label_col`` joined after a
    size check (broadcast when small). Unknown codes give a null label. Keys
    of ``labels`` must be unique: a repeated one repeats the rows of its code
    (``duplicate_keys`` reports them).
    """
    if isinstance(labels, Mapping):
        lookup = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        return df.withColumn(label, F.try_element_at(lookup, F.col(col)))
    side = labels.select(
        F.col(label_key).alias("__code"), F.col(label_col).alias(label)
    )
    side = bounded_broadcast(side, max_bytes)
    return df.join(side, df[col] == side["__code"], "left").drop("__code")


def filter_appointments(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    postings: Sequence[str] | None = None,
    period: tuple[int, int] | None = None,
    dates: tuple[date | datetime | str, date | datetime | str] | None = None,
    category_col: str = "category",
    posting_col: str = "posting",
    period_col: str = "period",
    date_col: str = "date",
) -> DataFrame:
    """P5: keep appointments of the given categories, postings and periods.

    ``period`` is an inclusive (first, last) range on an integer period
    column; ``dates`` is a half-open [start, end) range on a date or
    timestamp column. Prefer ``dates`` on a raw column: the range reaches
    the Parquet reader as pushed filters, where a function of the column
    would not.
    """
    cond = F.lit(True)
    if categories is not None:
        cond = cond & F.col(category_col).isin(list(categories))
    if postings is not None:
        cond = cond & F.col(posting_col).isin(list(postings))
    if period is not None:
        cond = cond & F.col(period_col).between(period[0], period[1])
    if dates is not None:
        c = F.col(date_col)
        # The bounds take the column's own type, so the column is compared
        # as stored and the range stays a pushed filter.
        kind = df.schema[date_col].dataType
        cond = cond & (c >= F.lit(dates[0]).cast(kind)) & (c < F.lit(dates[1]).cast(kind))
    return df.where(cond)


def profile(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    patterns: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    codes: Sequence[str] = (),
) -> DataFrame:
    """Q1: one row per column with row, null, distinct and pattern-miss counts.

    Row, null and pattern counts come from one aggregation over ``df``. Each
    exact distinct count is a scalar subquery over that column alone
    (de-duplicated map-side, then counted): this shuffles one narrow column
    at a time, where a multi-distinct aggregate would expand every row once
    per column. ``approx`` uses HyperLogLog++ sketches in the single pass
    instead. Columns named in ``codes`` (few distinct values each) share one
    pass: rows are counted per combination of their values, which combines in
    the map tasks, and all their figures come from those few counts. With
    ``key``, a row named ``key(a,b)`` gives the number of
    distinct key tuples without a null part. ``n_pattern_miss`` counts
    non-null values not matching the column's regular expression (null when
    no pattern is given).
    """
    cols = list(columns or df.columns)
    patterns = dict(patterns or {})
    keys = [key] if isinstance(key, str) else list(key or [])

    def exact_distinct(names: list[str]) -> Column:
        present = F.lit(True)
        for n in names:
            present = present & F.col(n).isNotNull()
        return df.where(present).select(*names).distinct().select(F.count(F.lit(1))).scalar()

    aggs = [F.count(F.lit(1)).alias("__rows")]
    distincts: dict[str, Column] = {}
    few = [(i, c) for i, c in enumerate(cols) if c in set(codes) and not approx]
    if few:
        combinations = df.groupBy(*[F.col(c).alias(f"__c{i}") for i, c in few]).agg(F.count(F.lit(1)).alias("__n"))
        facts = []
        for i, c in few:
            value = F.col(f"__c{i}")
            miss = F.lit(None).cast("bigint")
            if c in patterns:
                miss = F.coalesce(F.sum(F.when(~value.cast("string").rlike(patterns[c]), F.col("__n"))), F.lit(0))
            nn = F.coalesce(F.sum(F.when(value.isNotNull(), F.col("__n"))), F.lit(0))
            facts += [nn.alias(f"nn{i}"), miss.alias(f"m{i}"), F.count_distinct(value).alias(f"d{i}")]
        distincts["__few"] = combinations.agg(F.struct(*facts).alias("facts")).scalar()
    for i, c in enumerate(cols):
        if (i, c) in few:
            continue
        aggs.append(F.count(F.col(c)).alias(f"__nn{i}"))
        if c in patterns:
            miss = F.count_if(~F.col(c).cast("string").rlike(patterns[c]))
        else:
            miss = F.lit(None).cast("bigint")
        aggs.append(miss.alias(f"__m{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(F.col(c)).alias(f"__d{i}"))
        else:
            distincts[f"__d{i}"] = exact_distinct([c])
    if keys:
        if approx:
            aggs.append(F.approx_count_distinct(F.struct(*keys)).alias("__kd"))
        else:
            distincts["__kd"] = exact_distinct(keys)
    wide = df.agg(*aggs)
    if distincts:
        wide = wide.withColumns(distincts)
        wide = wide.withColumns({f"__{fact}{i}": F.col(f"__few.{fact}{i}") for i, _ in few for fact in ("nn", "m", "d")})
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("__rows").alias("n_rows"),
            (F.col("__rows") - F.col(f"__nn{i}")).alias("n_nulls"),
            F.col(f"__d{i}").cast("bigint").alias("n_distinct"),
            F.col(f"__m{i}").cast("bigint").alias("n_pattern_miss"),
        )
        for i, c in enumerate(cols)
    ]
    if keys:
        rows.append(
            F.struct(
                F.lit(f"key({','.join(keys)})").alias("column_name"),
                F.col("__rows").alias("n_rows"),
                F.lit(None).cast("bigint").alias("n_nulls"),
                F.col("__kd").cast("bigint").alias("n_distinct"),
                F.lit(None).cast("bigint").alias("n_pattern_miss"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def duplicate_keys(df: DataFrame, key: str | Sequence[str], name: str = "n") -> DataFrame:
    """Q2: keys occurring more than once, with their number of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def unmatched_codes(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    name: str = "n",
) -> DataFrame:
    """Q3: fact codes without a dimension row, with the number of facts each.

    The facts are counted per code first, so the anti join compares the
    distinct codes only; a null code is reported as a row of its own.
    """
    codes = fact.groupBy(fact_key).agg(F.count(F.lit(1)).alias(name))
    dim_keys = dim.select(F.col(dim_key).alias("__dim_key")).distinct()
    return codes.join(dim_keys, codes[fact_key] == dim_keys["__dim_key"], "left_anti")
