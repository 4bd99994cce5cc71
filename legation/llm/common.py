"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legation.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Compute ``df`` once and keep it in the session's shared checkpoint folder.

    Later steps read the written rows, so a lost executor costs a re-read and
    never a second run of what came before. ``narrow`` marks results of small
    rows after a shuffle: where the shuffle has far more partitions than
    cores, they are written as an eighth as many part files.
    """
    spark = df.sparkSession
    shared_dir(spark)  # names the shared folder for the context if it is unset
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = max(4 * spark.sparkContext.defaultParallelism, partitions // 8)
    if narrow and partitions > 4 * few:
        df = df.coalesce(few)
    return df.checkpoint()


def row_keys(docs: DataFrame, id_col: str, name: str = "__key") -> DataFrame:
    """``docs`` with a number of its own for every row in ``name``.

    It is the id where only one row has it. Rows that share an id, or have
    none, are written once to the shared folder and numbered there, above the
    largest id, so that every later step sees the same numbers and decides
    per row.
    """
    key = F.col(id_col).cast("long")
    shared = docs.groupBy(key.alias("__id")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 or __id is null")
    shared = cut(shared.select("__id"), narrow=True)
    if shared.isEmpty():
        return docs.withColumn(name, key)
    same = key.eqNullSafe(F.col("__id"))
    top = docs.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]
    numbered = docs.join(shared, same, "left_semi").withColumn(name, F.lit(top + 1).cast("long") + F.monotonically_increasing_id())
    return docs.join(shared, same, "left_anti").withColumn(name, key).unionByName(cut(numbered))


def text_of(col: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split record batches so that the texts of each hold about ``max_bytes`` at most.

    A single text above the bound forms a batch of its own.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > max_bytes:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        if len(sizes) > start:
            yield batch.slice(start)
