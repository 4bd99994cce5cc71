"""Run operators with injected task failures; print OK when results are unchanged.

Started by test_retry.py in its own process: a Spark context that allows
task retries (``local[4,3]``) cannot share the test session. The failure is
injected by a test-only Python UDF that raises on the first attempt of one
task in the stage feeding each shuffle, and once in a table write (whose
failed attempt must leave no rows behind); the library itself has no UDF.
"""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

sys.path.insert(0, sys.argv[1])

from legation.operators import diff_versions, rank_within  # noqa: E402
from legation.sources import load_table, read_table  # noqa: E402
from legation.plans import category_share_ranking  # noqa: E402
from legation.session import build_session  # noqa: E402


MARKS = tempfile.mkdtemp(prefix="legation-failures-")


@F.udf(LongType())
def flaky(x):
    tc = TaskContext.get()
    if tc.attemptNumber() == 0 and tc.partitionId() == 1:
        open(f"{MARKS}/stage{tc.stageId()}-task{tc.taskAttemptId()}", "w").close()
        raise RuntimeError("injected task failure")
    return x


def main() -> None:
    spark = build_session("local[4,3]", shuffle_partitions=4, extra={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="legation-retry-"))
    base = spark.range(0, 40_000, numPartitions=4)
    dim = spark.range(0, 50).select(
        F.col("id").alias("code"),
        F.concat(F.lit("S"), F.col("id")).alias("name"),
        (F.col("id") % 5).alias("continent"),
    )

    def facts(fail: bool):
        ident = flaky(F.col("id")) if fail else F.col("id")
        return base.select(
            ident.alias("id"),
            (F.col("id") % 50).alias("sender"),
            F.when(F.col("id") % 7 < 3, F.lit("W")).otherwise(F.lit("M")).alias("category"),
        )

    def results(fail: bool):
        f = facts(fail)
        flag = category_share_ranking(f, dim, "sender", "category", "W", "code", "name", "continent")
        ranked = rank_within(f.select("sender", (F.col("id") % 997).alias("v")), "sender", "v", large_groups=True)
        old = f.select((F.col("id") % 900).alias("k"), "category").dropDuplicates(["k"]).groupBy("k").agg(F.min("category").alias("c"))
        new = f.select((F.col("id") % 1000).alias("k"), F.lit("W").alias("c")).distinct()
        diff = diff_versions(old, new, "k")
        return [sorted(map(tuple, df.collect())) for df in (flag, ranked.distinct(), diff)]

    clean = results(False)
    disturbed = results(True)
    # a write whose task fails once: the retried attempt's files alone are committed
    out = tempfile.mkdtemp(prefix="legation-retry-write-")
    load_table(facts(True), f"{out}/t", partition_by=["category"])
    written = read_table(spark, f"{out}/t")
    expected = facts(False)
    n = expected.count()
    write_ok = written.count() == n and written.select("id").distinct().count() == n
    failures = len(os.listdir(MARKS))
    print(f"failures injected: {failures}")
    print("OK" if clean == disturbed and write_ok and failures > 0 else "DIFFERENT")
    spark.stop()


if __name__ == "__main__":
    main()
