"""A training-corpus pipeline: five operators in a row, each stage written before the next reads it.

``run(spark, sf_dir)`` applies the stages to ``documents``. Every stage but
the last returns the columns of its input and only the rows that stay; the
last returns one row per remaining document with the words the mix takes.
Every stage decides row by row: rows without an id, or that share one, are
judged by their own text. Null and empty texts pass through every stage by the
rules of its operator. Each run leaves one copy of what every stage kept in
the shared folder; remove the run's folder when it is not needed any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legation.llm.common import table
from legation.llm.decontam import drop_contaminated
from legation.llm.exact_dup import drop_exact_duplicates
from legation.llm.mixing import mix_by_source
from legation.llm.near_dup import drop_near_duplicates
from legation.llm.quality import drop_rejected
from legation.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, each by its own text."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the smallest id, null last; of rows with one id and text, the least by a hash of all columns."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the smallest id, rows without an id of their own last."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage, each by its own text; items without an id count too."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes of every remaining row; rows without an id are drawn by their text."""
    return mix_by_source(docs, fill=True)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminate),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# SQL can express neither the classifier nor the near-duplicate classes.
ORACLE_SQL = None
