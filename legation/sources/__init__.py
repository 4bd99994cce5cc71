"""Scans and sinks."""

from legation.sources.countries import (
    CONTINENT_CODES,
    COUNTRY_FILE_SCHEMA,
    country_issues,
    read_countries,
)
from legation.sources.delimited import (
    export_feed,
    good_rows,
    load_with_rejects,
    read_delimited,
    read_with_rejects,
    rejected_rows,
)
from legation.sources.tables import load_table, read_parquet_table, read_table

__all__ = [
    "CONTINENT_CODES",
    "COUNTRY_FILE_SCHEMA",
    "country_issues",
    "read_countries",
    "export_feed",
    "good_rows",
    "load_with_rejects",
    "rejected_rows",
    "load_table",
    "read_delimited",
    "read_parquet_table",
    "read_table",
    "read_with_rejects",
]
