"""Derive larger (and optionally skewed) copies of the driver tables, for timing only.

    python tools/scaled_copy.py SRC_DIR OUT_DIR COPIES [--hot-customer]

Each of ``COPIES`` copies of customer, supplier, orders and lineitem gets its
keys shifted by the copy number times the table's key range, so the copies
join only among themselves and every distribution is kept; nation and
region are copied as they are. With ``--hot-customer`` every third order is
moved to customer 0, which then holds a third of all orders (the skew case).
The copies are written by Spark as Parquet, 16 files per table so that
scans run in parallel; nothing is collected.
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

sys.path.insert(0, ".")
from legation.session import build_session  # noqa: E402


def main() -> None:
    src, out, copies = sys.argv[1], sys.argv[2], int(sys.argv[3])
    hot = "--hot-customer" in sys.argv
    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    t = {n: spark.read.parquet(f"{src}/{n}.parquet") for n in
         ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    span = {
        k: t[tab].agg(F.max(k)).first()[0] + 1
        for tab, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"))
    }

    def shifted(df, cols):
        exploded = df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        for c, key in cols.items():
            exploded = exploded.withColumn(c, F.col(c) + F.col("__copy") * F.lit(span[key]))
        return exploded.drop("__copy")

    tables = {
        "customer": shifted(t["customer"], {"c_custkey": "c_custkey"}),
        "supplier": shifted(t["supplier"], {"s_suppkey": "s_suppkey"}),
        "orders": shifted(t["orders"], {"o_orderkey": "o_orderkey", "o_custkey": "c_custkey"}),
        "lineitem": shifted(t["lineitem"], {"l_orderkey": "o_orderkey", "l_suppkey": "s_suppkey"}),
    }
    if hot:
        o = tables["orders"]
        tables["orders"] = o.withColumn(
            "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey"))
        )
    for name in ("region", "nation"):
        t[name].write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    for name, df in tables.items():
        # several files per table, as real inputs arrive, so scans run in parallel
        df.repartition(16, df.columns[0]).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
