"""Column expressions shared by the operators (all built-in, codegen-friendly)."""

from legation.functions.exprs import (
    cast_failed,
    count_rows,
    count_where,
    normalised_code,
    normalised_name,
    safe_ratio,
    to_col,
    to_type,
)

__all__ = [
    "cast_failed",
    "count_rows",
    "count_where",
    "normalised_code",
    "normalised_name",
    "safe_ratio",
    "to_col",
    "to_type",
]
