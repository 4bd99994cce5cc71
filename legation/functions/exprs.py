"""Column helpers.

Counting helpers accept an optional ``weight`` column so that operators can
run on raw facts (one row per appointment, weight ``None``) or on facts that
were pre-aggregated below a join (one row per group with a count column).
Both give the same numbers; the second shuffles far fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

ColumnLike = str | Column


def to_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_rows(weight: ColumnLike | None = None) -> Column:
    """Number of rows, or the sum of ``weight`` (as bigint)."""
    if weight is None:
        return F.count(F.lit(1))
    return F.coalesce(F.sum(to_col(weight)), F.lit(0)).cast("bigint")


def count_where(cond: Column, weight: ColumnLike | None = None) -> Column:
    """Rows where ``cond`` is true (null counts as false), optionally weighted."""
    if weight is None:
        return F.count_if(F.coalesce(cond, F.lit(False)))
    w = to_col(weight)
    return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")


def safe_ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / den`` as double; null when ``den`` is 0 or null (ANSI-safe)."""
    return to_col(num).cast("double") / F.nullif(to_col(den).cast("double"), F.lit(0.0))


# Whitespace that typically arrives in spreadsheet exports: ASCII blanks plus
# the no-break space. Runs of it collapse to one blank.
_BLANKS = r"[\s\x{00A0}]+"


def normalised_name(c: ColumnLike) -> Column:
    """Trim and collapse blanks; letters and diacritics are kept as they are."""
    return F.trim(F.regexp_replace(to_col(c), _BLANKS, " "))


def normalised_code(c: ColumnLike) -> Column:
    """A join code: blanks trimmed and collapsed, letters upper-cased."""
    return F.upper(normalised_name(c))


def cast_failed(raw: ColumnLike, typed: Column) -> Column:
    """True where a non-null input did not convert (the typed value is null)."""
    return to_col(raw).isNotNull() & typed.isNull()


def to_type(c: ColumnLike, data_type: DataType, fmt: str | None = None) -> Column:
    """Text converted to ``data_type``; null where it does not convert.

    ``fmt`` is a datetime pattern (for example ``dd/MM/yyyy``) for date and
    timestamp targets; other types use ``try_cast``.
    """
    col = to_col(c)
    if fmt is not None and isinstance(data_type, DateType):
        return F.try_to_date(col, fmt)
    if fmt is not None and isinstance(data_type, (TimestampType, TimestampNTZType)):
        return F.try_to_timestamp(col, F.lit(fmt)).cast(data_type)
    return col.try_cast(data_type)
