"""Loading tables for later reading (S3) and the driver's Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def load_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] | None = None,
    mode: str = "overwrite",
    fmt: str = "parquet",
    max_records_per_file: int | None = None,
    bucket_by: tuple[int, Sequence[str]] | None = None,
    table: str | None = None,
    replace: str = "partitions",
) -> str:
    """S3: write ``df`` as a table, optionally partitioned by columns.

    With ``partition_by`` the rows are first rebalanced on the partition
    columns (the ``rebalance`` hint): adaptive execution then splits a
    partition value that holds a large share of the rows over several tasks
    and packs small ones together, so one hot value neither lands in a
    single task nor produces a file per task for every value. An overwrite
    replaces the partitions present in ``df`` (``replace="partitions"``) or
    the whole table (``replace="table"``), whatever the session's setting.
    Returns ``path``.

    ``bucket_by=(n, cols)`` with a ``table`` name writes an external table
    hash-bucketed (and sorted) on ``cols`` into ``n`` buckets, registered in
    the session catalog: two tables bucketed alike on a join key then join
    without any shuffle (read them with ``spark.table``). One task writes and
    one task reads a bucket, which cannot be split at run time: keep
    bucketing for keys without a dominant value; for skewed keys the shuffled
    join with AQE's skew splitting is the safer plan.
    """
    cols = list(partition_by or [])
    if bucket_by is not None:
        if not table:
            raise ValueError("bucket_by needs a table name")
        n, keys = bucket_by
        # Repartitioned like the buckets, so each task writes one file per bucket.
        writer = df.repartition(n, *keys).write.mode(mode).format(fmt).option("path", path)
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        if cols:
            writer = writer.partitionBy(*cols)
        writer.bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
        return path
    out = df.hint("rebalance", *cols) if cols else df
    writer = out.write.mode(mode).format(fmt)
    if cols:
        overwrite = {"partitions": "dynamic", "table": "static"}[replace]
        writer = writer.partitionBy(*cols).option("partitionOverwriteMode", overwrite)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.save(path)
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table written by ``load_table``; filters on partition columns prune folders."""
    return spark.read.format(fmt).load(path)


TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
