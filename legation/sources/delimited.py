"""Delimited text in and out.

Source tables arrive as ``;``-separated UTF-8 text with a header (a byte
order mark before the header is dropped by the reader). Reads always use a
declared schema, never inference: inference costs an extra pass and makes
types depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from legation.functions.exprs import cast_failed, to_type

CORRUPT = "_corrupt_record"

# Quotes inside a quoted field are doubled (RFC 4180). An unquoted empty field
# is null and a quoted one is the empty string: the reader's null mark is a
# control character, so that no empty text equals it.
TEXT_OPTIONS = {"escape": '"', "nullValue": "\u0001", "emptyValue": ""}


def _reader(spark: SparkSession, schema: StructType, sep: str, header: bool, encoding: str, multi_line: bool = False):
    return (
        spark.read.schema(schema)
        .options(**TEXT_OPTIONS)
        .option("multiLine", multi_line)
        .option("sep", sep)
        .option("header", header)
        .option("encoding", encoding)
        # With a header, its names must equal the schema's (case-insensitive
        # by default): a file with reordered or renamed columns is refused
        # instead of being read into the wrong fields.
        .option("enforceSchema", False)
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sep: str = ";",
    header: bool = True,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    formats: dict[str, str] | None = None,
) -> DataFrame:
    """Typed scan; the first malformed row fails the job.

    ``schema`` carries the file's own column names (rename them afterwards
    with ``assign_names``). The rows are checked as by ``read_with_rejects``,
    non-nullable fields included, in a filter that reads every field: a
    caller that only counts, or selects one column, still fails on a
    malformed row. ``multi_line`` reads quoted line breaks; such files cannot
    be split over tasks.
    """
    checked = checked_rows(_raw(spark, path, schema, sep, header, encoding, multi_line), schema, formats)
    message = F.concat(F.lit("malformed row: "), F.col("_reject_reason"))
    sound = F.when(F.col("_rejected"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(sound).select(*[f.name for f in schema.fields])


def _raw(
    spark: SparkSession, path: str, schema: StructType, sep: str, header: bool, encoding: str, multi_line: bool
) -> DataFrame:
    """Every field as text, plus the corrupt-record column."""
    return (
        _reader(spark, text_with_corrupt(schema), sep, header, encoding, multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def read_with_rejects(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sep: str = ";",
    header: bool = True,
    encoding: str = "UTF-8",
    formats: dict[str, str] | None = None,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The same scan, split into good rows and rejected rows.

    Every field is read as text, then converted (``try_cast``, or the given
    date format). A row is
    rejected when a field does not convert, a non-nullable field is empty,
    or the parser saw the wrong number of fields. ``good`` has ``schema``;
    ``bad`` has the raw text of each field plus ``_reject_reason`` (the
    problems, joined by ``"; "``).

    The reject test reads every field, so the split does not change when a
    caller later selects only a few columns of ``good``. ``formats`` maps
    date or timestamp fields to their pattern (e.g. ``dd/MM/yyyy``).
    """
    return split_rejects(_raw(spark, path, schema, sep, header, encoding, multi_line), schema, formats)


def text_with_corrupt(schema: StructType) -> StructType:
    """Every field of ``schema`` as nullable text, plus the corrupt-record column."""
    return StructType(
        [StructField(f.name, StringType(), True) for f in schema.fields]
        + [StructField(CORRUPT, StringType(), True)]
    )


def checked_rows(raw: DataFrame, schema: StructType, formats: dict[str, str] | None = None) -> DataFrame:
    """Typed columns of ``schema`` plus the reject verdict, in one projection.

    ``raw`` holds every field as text plus the corrupt-record column (read
    with ``text_with_corrupt(schema)``; batch or streaming). Output: the typed
    fields, ``_reject_reason`` (null for a good row), ``_raw`` (the text
    fields of a rejected row, null for a good one) and ``_rejected``.
    """
    formats = formats or {}
    typed: dict[str, Column] = {
        f.name: to_type(f.name, f.dataType, formats.get(f.name)) for f in schema.fields
    }
    problems = [F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed row"))]
    for f in schema.fields:
        problems.append(F.when(cast_failed(f.name, typed[f.name]), F.lit(f"bad {f.name}")))
        if not f.nullable:
            problems.append(F.when(F.col(f.name).isNull(), F.lit(f"missing {f.name}")))
    reason = F.nullif(F.concat_ws("; ", *problems), F.lit(""))  # concat_ws skips nulls
    raw_text = F.struct(*[F.col(f.name) for f in schema.fields])
    return raw.select(
        *[typed[f.name].alias(f.name) for f in schema.fields],
        reason.alias("_reject_reason"),
        F.when(reason.isNotNull(), raw_text).alias("_raw"),
        reason.isNotNull().alias("_rejected"),
    )


def split_rejects(
    raw: DataFrame, schema: StructType, formats: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Type the text columns of ``raw`` and split good rows from rejected ones.

    Works on batch and streaming frames alike (``raw`` read with
    ``text_with_corrupt(schema)``). Each output is its own pass over
    ``raw``; ``load_with_rejects`` writes both in one pass.
    """
    checked = checked_rows(raw, schema, formats)
    good = checked.where(~F.col("_rejected")).select(*[f.name for f in schema.fields])
    bad = checked.where(F.col("_rejected")).select(
        *[F.col(f"_raw.{f.name}").alias(f.name) for f in schema.fields], "_reject_reason"
    )
    return good, bad


def load_with_rejects(
    spark: SparkSession,
    path: str,
    schema: StructType,
    table_path: str,
    partition_by: list[str] | None = None,
    sep: str = ";",
    header: bool = True,
    encoding: str = "UTF-8",
    mode: str = "overwrite",
    formats: dict[str, str] | None = None,
    multi_line: bool = False,
) -> str:
    """S2 with S3 in one pass: parse once, write good and rejected rows together.

    The table is partitioned by ``_rejected`` (then ``partition_by``), so
    ``good_rows`` and ``rejected_rows`` read back only their own folders.
    Parsing text is the costly part of a load; this reads the source once
    where writing the two outputs of ``read_with_rejects`` reads it twice.
    An overwrite replaces the whole table, so rejects of an earlier load do
    not outlive a corrected file. Returns ``table_path``.
    """
    from legation.sources.tables import load_table  # local: tables imports nothing from here

    raw = _raw(spark, path, schema, sep, header, encoding, multi_line)
    parts = ["_rejected", *(partition_by or [])]
    return load_table(checked_rows(raw, schema, formats), table_path, partition_by=parts, mode=mode, replace="table")


def good_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """Rows of a ``load_with_rejects`` table that passed (typed columns only)."""
    df = spark.read.parquet(table_path)
    keep = [c for c in df.columns if c not in ("_reject_reason", "_raw", "_rejected")]
    # Partition discovery reads the flag back as text; the cast keeps pruning.
    return df.where(~F.col("_rejected").cast("boolean")).select(*keep)


def rejected_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """Rejected rows of a ``load_with_rejects`` table: raw text and reason."""
    df = spark.read.parquet(table_path).where(F.col("_rejected").cast("boolean"))
    return df.select("_raw.*", "_reject_reason")


def export_feed(
    df: DataFrame,
    path: str,
    sep: str = ";",
    header: bool = True,
    mode: str = "overwrite",
    max_records_per_file: int | None = None,
) -> str:
    """Write ``df`` as delimited text for a charting tool; returns ``path``.

    Quotes are doubled, nulls are empty fields and empty texts quoted ones,
    outer blanks are kept; a feed with line breaks in a text is read back with
    ``multi_line``. Feeds are aggregates, so they are small, but nothing here gathers them
    into one task: each task writes its own part file.
    """
    writer = df.write.mode(mode).option("sep", sep).option("header", header).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.csv(path)
    return path
