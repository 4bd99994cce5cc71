"""Representation analytics on Spark DataFrames.

The package answers "who was appointed, by whom, where" questions over an
appointments fact table and a country dimension: typed delimited scans,
data-quality checks, sender/receiver enrichment, category counts, shares,
parity ratios, subtotals, cross-tabs, rankings, period changes and version
merges of reference tables.

Every operator takes and returns a ``pyspark.sql.DataFrame`` and is built
from built-in Spark SQL expressions, so Catalyst plans the whole query.
No operator creates a session or collects rows to the driver.
"""

from legation.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
