"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legation.llm.common import table
from legation.llm.collocations import collocations
from legation.llm.decontam import benchmark_matches
from legation.llm.exact_dup import exact_duplicates
from legation.llm.html_text import main_text
from legation.llm.licenses import license_scan
from legation.llm.mixing import mix_by_source
from legation.llm.near_dup import near_duplicates
from legation.llm.prefix_trie import prefix_trie
from legation.llm.quality import classify
from legation.llm.secrets import secret_scan
from legation.llm.tokens import load_vocabulary, token_counts
from legation.llm.url_lists import list_keys, url_verdicts
from legation.llm.warc import archive_round_trip
from legation.session import shared_dir

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
YEAR = 31_536_000  # seconds
START = 1_704_067_200  # 2024-01-01


def op1_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), load_vocabulary(VOCABULARY))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _number(text: str) -> Column:
    """The first 32 bits of the text's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.expr(text).cast("binary")), 1, 8), 16, 10).cast("long")


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated block and allow list over the keys of the pages' own URLs.

    No list ships with the tables, so its entries are derived: of the distinct
    keys two in five are listed; each entry is added, removed and added again
    at times drawn from the key's MD5.
    """
    keys = pages.select(F.explode(list_keys(F.col("url"))).alias("key")).distinct()
    drawn = keys.select("key", _number("key").alias("h"), _number("concat('at:', key)").alias("t")).filter("h % 5 < 2")
    listed = drawn.select(
        "key",
        F.when(F.col("h") % 7 < 5, "block").otherwise("allow").alias("verdict"),
        F.concat(F.lit("list"), (F.col("h") % 3).cast("string")).alias("category"),
        F.explode(F.array(*[
            F.struct((F.lit(START) + (F.col("t") * step + step * 12_345_678) % YEAR).alias("at"), F.lit(action).alias("action"))
            for step, action in ((1, "add"), (3, "remove"), (7, "add"))
        ])).alias("c"),
    )
    return listed.select("key", "verdict", "category", "c.at", "c.action")


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.lit(START) + _number("cast(page_id as string)") % YEAR  # the tables hold no fetch time
    return url_verdicts(pages.withColumn("fetched_at", fetched), list_changes(pages))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the source; repository: the source's documents of one language."""
    return secret_scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_source(table(spark, sf_dir, "documents"), fill=True)


def op8_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_matches,
        op2_token_counts,
        op3_license_scan,
        op4_near_duplicates,
        op5_url_verdicts,
        op6_secret_scan,
        op7_mix_sources,
        op8_archive,
        op9_exact_duplicates,
        op10_quality,
        op11_collocations,
        op12_main_text,
        op13_prefix_trie,
    )
}
