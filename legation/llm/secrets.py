"""Secret scans with corpus-wide ownership frequency, in SQL functions only.

Regular expressions find candidate spans in every whole text. Positions come
from the lengths of the pieces between the matches. Each candidate's secret is
kept as a hash; how many distinct owners and repositories hold the same hash
tells examples that everyone copies from credentials of one owner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legation.llm.common import cut, text_of

# kind, what every match contains (None: no fixed part), pattern, group of the secret, least length of the secret.
# Runs that are too short are left out by the pattern itself where that finds the same spans.
_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE_KINDS = (
    ("assign", None, _ASSIGN, 2, 6),
    ("access", "AKIA", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", None, r"[0-9a-f]{24,}", 0, 24),
)
MORE_KINDS = (
    ("jwt", "eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private", "PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*", 0, 27),
)


def _found(text: Column, contains: str | None, pattern: str, group: int) -> Column:
    """Lengths of the pieces between the matches, and of each match its length and its secret's length, variety and hash."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    hit = F.arrays_zip(whole.alias("w"), secret.alias("s"))
    entry = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("p"), hit.alias("h")),
        lambda x: F.struct(
            F.length(x["p"]).cast("long").alias("gap"),
            F.length(x["h"]["w"]).cast("long").alias("span"),
            F.length(x["h"]["s"]).alias("secret_len"),
            F.size(F.array_distinct(F.split(x["h"]["s"], ""))).alias("variety"),
            F.sha2(x["h"]["s"].cast("binary"), 256).alias("hash"),
        ),
    )
    test = text.rlike(pattern) if contains is None else text.contains(contains) & text.rlike(pattern)
    return F.when(test, entry)


def secret_candidates(
    docs: DataFrame, owner: Column, repository: Column, text_col: str = "text", kinds=BASE_KINDS + MORE_KINDS
) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: every input row under a row number, and one row per candidate span.

    Spans: ``row, owner, repo, kind, rank, start, end, variety, hash``; start
    and end (exclusive) count characters. Matches of a kind are leftmost and
    non-overlapping; a match whose secret is too short is left out after
    matching. Only lengths and hashes of secrets are kept.
    """
    text = text_of(text_col)
    lists = [_found(text, *kind[1:4]).alias(f"__k{i}") for i, kind in enumerate(kinds)]
    rows = docs.select("*", F.monotonically_increasing_id().alias("__row"), owner.alias("__owner"), repository.alias("__repo"), *lists)
    rows = cut(rows.drop(text_col))
    any_hit = reduce(lambda a, b: a | b, [F.col(f"__k{i}").isNotNull() for i in range(len(kinds))])
    hits = rows.filter(any_hit)
    parts = [
        hits.select(
            F.col("__row").alias("row"), F.col("__owner").alias("owner"), F.col("__repo").alias("repo"),
            F.lit(kind).alias("kind"), F.lit(i).alias("rank"), F.lit(least).alias("least"),
            F.posexplode(f"__k{i}").alias("at", "m"),
        )
        for i, (kind, _, _, _, least) in enumerate(kinds)
    ]
    # A row's matches of one kind: bounded by its text.
    upto = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    moved = reduce(DataFrame.union, parts).withColumn("end", F.sum(F.col("m.gap") + F.coalesce(F.col("m.span"), F.lit(0))).over(upto))
    spans = moved.filter("m.span is not null and m.secret_len >= least").select(
        "row", "owner", "repo", "kind", "rank", (F.col("end") - F.col("m.span")).alias("start"), "end",
        F.col("m.variety").alias("variety"), F.col("m.hash").alias("hash"),
    )
    return rows, cut(spans, narrow=True)


def ownership(spans: DataFrame) -> DataFrame:
    """Per secret hash the distinct owners and repositories in the whole corpus.

    Distinct triples first, so that copies collapse in the map tasks and a
    secret in a third of all rows is a row per task and repository. Null
    owners and repositories count as one each.
    """
    triples = spans.select("hash", "owner", "repo").groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = triples.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def secret_scan(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    example_owners: int = 3,
    live_variety: int = 6,
) -> DataFrame:
    """One row per document: ``<id>, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example, max_owners``.

    ``base_sha256`` digests the base kinds' spans, ``spans`` lists all kinds'.
    A candidate is an example if at least ``example_owners`` owners hold the
    same secret or it has fewer than ``live_variety`` distinct characters,
    live if one owner holds it, else shared. Null and empty texts have no
    spans; ids may be null or repeated, every input row gives one row; other
    columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), owner.alias("owner"), repository.alias("repo"))
    rows, spans = secret_candidates(base, F.col("owner"), F.col("repo"), "text")
    # Written before it is joined back, so that the spans of a secret that everyone holds can be split over tasks.
    known = spans.join(cut(ownership(spans), narrow=True), "hash")
    example = (F.col("n_owners") >= example_owners) | (F.col("variety") < live_variety)
    named = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    per_row = known.groupBy("row").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind, *_ in BASE_KINDS],
        F.count_if(~example & (F.col("n_owners") == 1)).alias("n_live"),
        F.count_if(~example & (F.col("n_owners") > 1)).alias("n_shared"),
        F.count_if(example).alias("n_example"),
        F.max("n_owners").alias("max_owners"),
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", named.alias("text")))).alias("all"),
    )
    base_kinds = F.filter("all", lambda s: s["rank"] < len(BASE_KINDS))
    joined = lambda spans_: F.coalesce(F.array_join(F.transform(spans_, lambda s: s["text"]), ","), F.lit(""))
    counts = [f"n_{kind}" for kind, *_ in BASE_KINDS]
    out = rows.select(F.col("id"), F.col("__row")).join(per_row, rows["__row"] == per_row["row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("id").alias(id_col),
        *[zero(c) for c in counts],
        F.sha2(joined(base_kinds).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        *[zero(c) for c in ("n_live", "n_shared", "n_example", "max_owners")],
    )
