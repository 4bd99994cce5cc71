"""Size-checked broadcasting.

A side is broadcast only if Spark's own size estimate of it, after column
pruning, is within a bound; otherwise it is returned untouched and Spark plans
a shuffled join (sort-merge, or a broadcast chosen by AQE from run-time
sizes). The estimate comes from the optimised plan, that is from file sizes
for a scan, so no job runs while a query is built. A side whose estimate is
unknown or inflated (a join, an aggregate) is simply not hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Estimated bytes of the projected side; well under the executors' memory.
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``, from its optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int | None = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its estimated size is at most ``max_bytes``, else ``df``.

    ``max_bytes=None`` returns ``df`` unhinted.
    """
    if max_bytes is None or estimated_bytes(df) > max_bytes:
        return df
    return F.broadcast(df)
