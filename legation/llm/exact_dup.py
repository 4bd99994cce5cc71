"""Exact deduplication by content sort.

Texts are normalised and range-partitioned by splitters that Spark samples:
on their first characters, then on a hash of the whole text (so that samples
are short whatever the texts), then on the id. Each partition is sorted
(externally, with spill) so that equal texts stand next to each other, and one
pass compares every text with its neighbour in full. As the id is part of the
key, a text with a great many copies is cut over several partitions; the runs
at partition borders are then united by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legation.llm.common import cut, text_of

LEAD = 32  # characters of a text in a splitter

# A white-space run that is not already a single space.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(col: str) -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(text_of(col), _RUN, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbour comparison over sorted (hash, text, id) rows: one output row per input row.

    A run may go on in another partition only if it has the hash of the
    partition's first or last row; such runs are marked ``edge``. Holds the ids
    of the current run only.
    """
    names = ("id", "keep", "size", "sha", "head", "edge")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    rows: list[list] = [[] for _ in names]
    text, ids, first, last, tail = None, [], None, None, 0

    def flush() -> None:
        n, sha = len(ids), hashlib.sha256(text).hexdigest()
        for column, value in zip(rows, (ids, [ids[0]] * n, [n] * n, [sha] * n, [True] + [False] * (n - 1), [last == first] * n)):
            column.extend(value)

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=list(names))
        for column in rows:
            column.clear()
        return batch

    for batch in batches:
        hashes, texts, keys = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()
        for mark, value, key in zip(hashes, texts, keys):
            value = value.as_py()
            if value == text:
                ids.append(key)
                continue
            if text is not None:
                flush()
                if mark != last:
                    if len(rows[0]) >= 10_000:
                        yield taken()
                    tail = len(rows[0])  # rows of the current hash start here
            first = mark if text is None else first
            text, ids, last = value, [key], mark
    if text is not None:
        flush()
        rows[names.index("edge")][tail:] = [True] * (len(rows[0]) - tail)
        yield taken()


_RUN_ROWS = "id long, keep long, size long, sha string, head boolean, edge boolean"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``<id>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms (:func:`normalised`) are
    identical. The row with the smallest id of a group stays. Null text is
    empty text; null ids sort last, so such a row stays only where no row of
    its group has an id (``keep_id`` is then null). Of repeated rows with the
    same id and text exactly one is ``kept``. An empty table gives no rows;
    other columns of ``docs`` are ignored.
    """
    text, key = F.col("text"), F.col("id").asc_nulls_last()
    source = docs.select(normalised(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    source = source.select(F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("hash"), "text", "id")
    dealt = source.repartitionByRange("lead", "hash", key).sortWithinPartitions("lead", "hash", text, key)
    runs = dealt.select("hash", "text", "id").mapInArrow(_runs, _RUN_ROWS)
    runs = cut(runs, narrow=True)
    edges = runs.filter("head and edge").groupBy("sha").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.min("keep").alias("whole_keep"),
        F.sum("size").alias("whole_size"),
    )
    # A text or two per partition stand at a border, whatever the number of rows.
    spanning = edges.filter("n_parts > 1").select(
        F.col("sha").alias("edge_sha"), "whole_keep", "whole_size"
    )
    out = runs.join(F.broadcast(spanning), runs["sha"] == spanning["edge_sha"], "left")
    across = F.col("edge_sha").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(across, F.col("whole_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(across, F.col("whole_size")).otherwise(F.col("size")).alias("group_size"),
        # Rows with one text and id share a partition, so one head has the smallest id.
        (F.col("head") & (~across | F.col("keep").eqNullSafe(F.col("whole_keep")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    Kept (id, digest) pairs select rows; only where a kept pair occurs more
    than once (repeated rows) are those rows, and no others, numbered, in the
    order of a hash of all their columns: which of them stays does not depend
    on row order.
    """
    found = cut(exact_duplicates(docs, id_col, text_col))
    kept = found.filter("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(normalised(text_col).cast("binary"), 256)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    repeated = cut(
        found.groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    )
    if repeated.isEmpty():
        return docs.join(kept, same, "left_semi")
    once = docs.join(kept, same, "left_semi")
    plain, again = once.join(repeated, same, "left_anti"), once.join(repeated, same, "left_semi")
    order = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    place = F.row_number().over(Window.partitionBy(id_col, sha).orderBy(order))
    one_each = again.withColumn("__place", place).filter("__place = 1").drop("__place")
    return plain.unionByName(one_each)


