"""Incremental load: the extract-transform-load step (S1-S3) for files that keep arriving.

Delimited files landing in a folder are typed and checked exactly as
``read_with_rejects`` does and appended, in one pass, to a Parquet table
partitioned by ``_rejected`` (the layout of ``load_with_rejects``; read it
back with ``good_rows`` and ``rejected_rows``). Spark's file sink commits
every micro-batch through its metadata log and the query keeps its progress
in a checkpoint, so a file is loaded exactly once even when executors are
lost or the job is restarted. ``availableNow`` processes what is present and
stops, so the same code serves a scheduled batch run and a continuous one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from legation.sources.delimited import CORRUPT, TEXT_OPTIONS, checked_rows, text_with_corrupt


def incremental_load(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    table_path: str,
    checkpoint_dir: str | None = None,
    partition_by: Sequence[str] | None = None,
    sep: str = ";",
    header: bool = True,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    formats: dict[str, str] | None = None,
) -> StreamingQuery:
    """Start the load query; ``awaitTermination()`` waits for an ``availableNow`` run.

    ``checkpoint_dir`` defaults to ``<table_path>.checkpoint``, next to the
    table: every later run on the table finds its progress there and loads
    the files that are new since.
    """
    ckpt = checkpoint_dir or f"{table_path.rstrip('/')}.checkpoint"
    reader = (
        spark.readStream.schema(text_with_corrupt(schema))
        .option("sep", sep)
        .option("header", header)
        .option("enforceSchema", False)  # each file's header must match the schema
        .options(**TEXT_OPTIONS)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    checked = checked_rows(reader.csv(source_dir), schema, formats)
    writer = (
        checked.writeStream.format("parquet")
        .option("checkpointLocation", ckpt)
        .partitionBy("_rejected", *(partition_by or []))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(table_path)
