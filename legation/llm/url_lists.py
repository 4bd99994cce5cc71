"""URL filters: an as-of join of captures with dated list entries, in SQL functions only.

List changes (an entry added or removed at a time) become validity intervals:
each change holds until the next one of the same entry. A capture is judged by
the entries active when it was fetched; the most specific entry decides.

The as-of join runs in two levels. Time is cut into buckets; inside a bucket
of one entry, changes and lookups are ordered together and each lookup sees
the last change before it. The state at the start of a bucket comes from a
second, small pass over one row per entry and bucket. A popular host is
thereby spread over the buckets instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legation.llm.common import cut

STREAM = ("key", "verdict", "category")


def url_host(url: Column) -> Column:
    """The host in lower case, without scheme, user, port and final dot."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r"(:[0-9]*)?$|\.(:[0-9]*)?$", "")


def first_segment(url: Column) -> Column:
    """The first path segment, empty if there is none."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_extract(rest, r"^[^/?#]*/([^/?#]*)", 1)


def list_keys(url: Column) -> Column:
    """The list keys that cover a URL: its host, each parent domain, and host/first-segment.

    Names of more than 253 characters are no host names and have no keys.
    """
    host, segment = url_host(url), first_segment(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    deep = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when((host != "") & (F.length(host) <= 253), F.array_distinct(F.concat(domains, deep))).otherwise(F.array().cast("array<string>"))


def _as_of(changes: DataFrame, lookups: DataFrame, bucket_seconds: int) -> DataFrame:
    """For every lookup (stream, at) inside an active interval: the stream, at, valid_from, valid_to.

    ``changes``: stream, at, active (one row per stream and time).
    """
    bucket = F.floor(F.col("at") / bucket_seconds).cast("long").alias("bucket")
    marks = changes.select(*STREAM, "at", bucket, F.struct("at", "active").alias("change"))
    asks = lookups.select(*STREAM, "at", bucket, F.lit(None).cast("struct<at:bigint,active:boolean>").alias("change"))
    both = marks.union(asks)
    inside = Window.partitionBy(*STREAM, "bucket").orderBy("at", F.col("change").isNull())
    back = Window.partitionBy(*STREAM, "bucket").orderBy(F.col("at").desc(), F.col("change").isNull().desc())
    seen = both.select(
        "*",
        F.last("change", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.last("change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    ).filter("change is null")
    # One row per stream and bucket: at most the time span over the bucket width for each stream.
    steps = both.groupBy(*STREAM, "bucket").agg(F.min("change").alias("first"), F.max("change").alias("final"))
    line = Window.partitionBy(*STREAM).orderBy("bucket")
    carry = steps.select(
        *[F.col(c).alias(f"s_{c}") for c in (*STREAM, "bucket")],
        F.last("final", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("coming"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*STREAM, "bucket")]
    joined = seen.join(carry, same[0] & same[1] & same[2] & same[3])
    held = joined.select(*STREAM, "at", F.coalesce("before", "carried").alias("b"), F.coalesce("after", "coming").alias("a"))
    return held.filter("b.active").select(*STREAM, "at", F.col("b.at").alias("valid_from"), F.col("a.at").alias("valid_to"))


def url_verdicts(
    captures: DataFrame,
    changes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """One row per capture: ``<id>, <url>, <time>, verdict, entry, category, valid_from, valid_to, n_active``.

    ``changes``: ``key`` (a domain, which covers its subdomains, or
    host/first-segment), ``verdict`` ('block' or 'allow'), ``category``,
    ``at`` and ``action`` ('add' or 'remove'). Times are seconds (long). An
    entry is active from an add, that moment included, until its next change;
    of an add and a remove at the same time the remove counts, and repeated
    rows count once. The longest active key decides; of equal keys 'block'
    comes before 'allow', then the first category. ``valid_to`` is null for an
    interval without an end.

    Captures without a URL or time match nothing: verdict 'none', as for those
    that no active entry covers. Changes without key or time are left out;
    null verdicts and categories are values of their own. Repeated captures
    give a row each; an empty table of captures gives no rows; other columns
    are ignored.
    """
    captures = captures.select(F.col(id_col), F.col(url_col).cast("string").alias(url_col), F.col(time_col).cast("long").alias(time_col))
    dated = changes.filter("key is not null and at is not null").select(*STREAM, F.col("at").cast("long").alias("at"), "action")
    dated = cut(dated.groupBy(*STREAM, "at").agg((~F.bool_or(F.col("action") == "remove")).alias("active")), narrow=True)
    asked = captures.filter(F.col(url_col).isNotNull() & F.col(time_col).isNotNull()).select(F.col(url_col).alias("u"), F.col(time_col).alias("at")).distinct()
    keyed = asked.select("u", "at", F.explode(list_keys(F.col("u"))).alias("key"))
    lookups = keyed.select("key", "at").distinct().join(dated.select(*STREAM).distinct(), "key")
    active = _as_of(dated, lookups, bucket_seconds)
    rank = F.struct(
        (-F.length("key")).alias("specific"), (F.col("verdict") != "block").alias("allowed"), "category", "key", "verdict", "valid_from", "valid_to"
    )
    best = keyed.join(active, ["key", "at"]).groupBy("u", "at").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    out = captures.join(best, (captures[url_col] == best["u"]) & (captures[time_col] == best["at"]), "left")
    return out.select(
        id_col, url_col, time_col,
        F.when(F.col("best").isNotNull(), F.col("best.verdict")).otherwise("none").alias("verdict"),
        F.col("best.key").alias("entry"), F.col("best.category").alias("category"),
        F.col("best.valid_from").alias("valid_from"), F.col("best.valid_to").alias("valid_to"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
    )
