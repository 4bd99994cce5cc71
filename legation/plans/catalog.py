"""One query per operator on the stand-in star, with its DuckDB oracle.

Each query takes ``(spark, sf_dir)``, reads the driver's Parquet tables in
full and returns a DataFrame; ``ORACLE`` holds the equivalent SQL for DuckDB
over the same tables. Column names and types are aligned on both sides
(counts bigint, shares double, ranks and flags int, periods int).

Queries for the sources (S1-S4) write their intermediate files under the
session's shared checkpoint folder and read them back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legation.operators import (
    active_members,
    assign_names,
    bilateral_matrix,
    change_over,
    complete,
    conform_types,
    count_by,
    count_cast_failures,
    crosstab,
    decode,
    diff_versions,
    distinct_partners,
    duplicate_keys,
    enrich,
    enrich_both,
    filter_appointments,
    fold_batches,
    in_post,
    inactive_members,
    join_as_of,
    keys_and_dependencies,
    maintained_counts,
    marginals,
    melt,
    merge_versions,
    normalise_keys,
    parity_ratio,
    profile,
    quantiles_by,
    rank_within,
    record_changes,
    rollup_counts,
    share_by,
    share_intervals,
    share_of_total,
    signed_changes,
    suggested_matches,
    tenure_spells,
    top_k,
    top_n_per_group,
    unmatched_codes,
    validity,
    whole_row_changes,
)
from legation.plans.flagship import category_share_ranking
from legation.plans.report import representation_feeds
from legation.plans.star import Star
from legation.session import shared_dir
from legation.sources import (
    CONTINENT_CODES,
    country_issues,
    export_feed,
    good_rows,
    load_table,
    load_with_rejects,
    read_countries,
    read_delimited,
    read_table,
    read_with_rejects,
    rejected_rows,
)

# Fixed parameters of the stand-in questions.
CATEGORY = "F"  # the category whose share is measured
OTHER = "O"  # the parity ratio's denominator category
CATEGORIES = ["F", "O", "P"]  # every category value, for cross-tabs
URGENT = "1-URGENT"
CUTOFF = "1997-01-01"  # the older version of the customer table knows orders before this

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- shared parts


def _period() -> Column:
    return F.year("o_orderdate").alias("period")


def _customers_before(star: Star, cutoff: str = CUTOFF) -> DataFrame:
    """Older version of the customer table: customers with an order before ``cutoff``."""
    cond = F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")
    return active_members(star.t("customer"), star.t("orders"), "c_custkey", "o_custkey", cond)


def _customers_since(star: Star, cutoff: str = CUTOFF) -> DataFrame:
    cond = F.col("o_orderdate") >= F.lit(cutoff).cast("timestamp_ntz")
    return active_members(star.t("customer"), star.t("orders"), "c_custkey", "o_custkey", cond)


def _rebalanced(star: Star, customers: DataFrame) -> DataFrame:
    """``customers`` with c_acctbal lowered by 100 per open order (the update)."""
    open_orders = count_by(
        star.t("orders").where(F.col("o_orderstatus") == F.lit(OTHER)), "o_custkey", name="n_open"
    )
    # open_orders is an aggregate: no size probe, AQE picks the join at run time
    joined = enrich(customers, open_orders, "c_custkey", "o_custkey", ["n_open"], max_bytes=None)
    new_bal = F.when(
        F.col("n_open").isNotNull(),
        F.col("c_acctbal") - (F.col("n_open") * F.lit(100)).cast("double"),
    ).otherwise(F.col("c_acctbal"))
    return joined.withColumn("c_acctbal", new_bal).select(*customers.columns)


def _sender_counts(star: Star, *by: str) -> DataFrame:
    """Orders counted per (customer, *by), then placed in the sending state."""
    orders = star.t("orders").withColumn("period", F.year("o_orderdate"))
    return star.by_sender(count_by(orders, "o_custkey", *by))


def _nation_counts(star: Star) -> DataFrame:
    return count_by(_sender_counts(star), "r_name", "n_name", weight="n")


def _nation_shares(star: Star) -> DataFrame:
    counted = _sender_counts(star, "o_orderstatus")
    return share_by(counted, "n_name", "o_orderstatus", CATEGORY, weight="n")


def _crosstab(star: Star) -> DataFrame:
    return crosstab(star.t("orders"), "o_orderpriority", "o_orderstatus", CATEGORIES)


def _text_orders(star: Star) -> DataFrame:
    """Orders as text, as a spreadsheet export would give them.

    Prices of status ``P`` use a decimal comma (a locale defect), so those
    rows fail to convert to double.
    """
    orders = star.t("orders")
    price = F.col("o_totalprice").cast("string")
    price = F.when(
        F.col("o_orderstatus") == F.lit("P"), F.regexp_replace(price, r"\.", ",")
    ).otherwise(price)
    cols = [
        price.alias(c) if c == "o_totalprice" else F.col(c).cast("string").alias(c)
        for c in orders.columns
    ]
    return orders.select(*cols)


# ---------------------------------------------------------------- S: sources


def s1_read_delimited(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    customer = star.t("customer")
    path = export_feed(customer, shared_dir(spark, "s1-customer"))
    return read_delimited(spark, path, customer.schema)


def s2_read_with_rejects(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    path = export_feed(_text_orders(star), shared_dir(spark, "s2-orders"))
    good, bad = read_with_rejects(spark, path, star.t("orders").schema)
    rows = good.select("o_orderstatus", F.lit(None).cast("string").alias("_reject_reason"))
    rows = rows.unionByName(bad.select("o_orderstatus", "_reject_reason"))
    return count_by(rows, "o_orderstatus", "_reject_reason")


def s2_load_with_rejects(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    src = export_feed(_text_orders(star), shared_dir(spark, "s2-orders"))
    table = load_with_rejects(spark, src, star.t("orders").schema, shared_dir(spark, "s2-loaded"))
    rows = good_rows(spark, table).select("o_orderstatus", F.lit(None).cast("string").alias("_reject_reason"))
    rows = rows.unionByName(rejected_rows(spark, table).select("o_orderstatus", "_reject_reason"))
    return count_by(rows, "o_orderstatus", "_reject_reason")


def s3_load_table(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    appts = star.t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", _period())
    path = load_table(appts, shared_dir(spark, "s3-orders"), partition_by=["period", "o_orderstatus"])
    table = read_table(spark, path)
    kept = table.where(F.col("period").between(1996, 1998) & F.col("o_orderstatus").isin("F", "O"))
    return count_by(kept, "period", "o_orderstatus", "o_orderpriority")


def s4_export_feed(spark: SparkSession, d: str) -> DataFrame:
    tab = _crosstab(Star.of(spark, d))
    path = export_feed(tab, shared_dir(spark, "s4-feed"))
    return read_delimited(spark, path, tab.schema)


def s2_reloaded_rows(spark: SparkSession, d: str) -> DataFrame:
    """All fields of good and rejected rows after a load, a corrected reload, and the first load again."""
    star = Star.of(spark, d)
    orders = star.t("orders")
    wrong = export_feed(_text_orders(star), shared_dir(spark, "s2-orders"))
    fixed = export_feed(orders, shared_dir(spark, "s2-fixed"))
    table = shared_dir(spark, "s2-loaded")
    for source in (wrong, fixed, wrong):
        load_with_rejects(spark, source, orders.schema, table)
    dated = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")
    good = good_rows(spark, table).withColumn("price", F.col("o_totalprice"))
    good = good.select(*[F.col(c).cast("string").alias(c) for c in orders.columns if c != "o_orderdate"], dated, "price")
    # Rejected rows keep their text as it stood in the file.
    bad = rejected_rows(spark, table).select(*orders.columns, F.lit(None).cast("double").alias("price"), "_reject_reason")
    return good.withColumn("_reject_reason", F.lit(None).cast("string")).unionByName(bad)


def s3_loaded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of orders, loaded by period in two parts that replace only their own periods."""
    orders = Star.of(spark, d).t("orders").withColumn("period", F.year("o_orderdate"))
    path = shared_dir(spark, "s3-rows")
    load_table(orders, path, partition_by=["period"])
    load_table(orders.where("period = 1996"), path, partition_by=["period"])
    return read_table(spark, path).select(*orders.columns)


def s4_texts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, separators, outer blanks and line breaks, empty and null ones, written and read back."""
    customer = Star.of(spark, d).t("customer")
    kind = F.col("c_custkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('say "'), "c_name", F.lit('" ok')))
        .when(kind == 1, F.concat(F.lit("  a;b "), "c_name", F.lit("  ")))
        .when(kind == 2, F.concat("c_name", F.lit("\n"), "c_mktsegment"))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, F.concat(F.lit("back\\slash "), "c_name"))
    )
    texts = customer.select("c_custkey", text.alias("text"))
    return read_delimited(spark, export_feed(texts, shared_dir(spark, "s4-texts")), texts.schema, multi_line=True)


# ---------------------------------------------------------------- C, R: country file and report


def _country_file(star: Star) -> str:
    """The nations as a country file: generic header, code, name and continent code."""
    nation = star.t("nation").select(
        F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 3))).alias("column1"),
        F.concat("n_name", F.lit("  ")).alias("column2"),
        F.col("n_regionkey").cast("int").alias("column3"),
    )
    return export_feed(nation, shared_dir(star.spark, "countries"))


def c1_read_countries(spark: SparkSession, d: str) -> DataFrame:
    return read_countries(spark, _country_file(Star.of(spark, d)))


def c2_country_issues(spark: SparkSession, d: str) -> DataFrame:
    return country_issues(read_countries(spark, _country_file(Star.of(spark, d))), CONTINENT_CODES)


def _feeds(star: Star) -> dict[str, DataFrame]:
    """The report over orders: sender and category of each, its posting and period; nations are the countries."""
    orders = star.t("orders").select("o_custkey", "o_orderstatus", "o_orderpriority", _period())
    linked = enrich(orders, star.customer_link(), "o_custkey", "c_custkey", ["c_nationkey"])
    return representation_feeds(
        linked, star.countries(), CATEGORY, CATEGORIES, OTHER, sender="c_nationkey", receiver=None,
        category_col="o_orderstatus", posting_col="o_orderpriority", period_col="period",
        code="n_nationkey", name="n_name", continent="r_name",
    )


def r1_share_by_state(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(Star.of(spark, d))["share_by_state"]


def r2_counts_with_subtotals(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(Star.of(spark, d))["counts_with_subtotals"]


def r3_state_by_period(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(Star.of(spark, d))["state_by_period"]


def r4_share_by_period(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(Star.of(spark, d))["share_by_period"]


def r5_parity_by_state(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(Star.of(spark, d))["parity_by_state"].select("n_name", "r_name", "n_numerator", "n_denominator", "ratio")


# ---------------------------------------------------------------- P, Q: cleaning and checks


def p1_assign_names(spark: SparkSession, d: str) -> DataFrame:
    orders = Star.of(spark, d).t("orders")
    return assign_names(
        orders,
        {
            "o_orderkey": "appointment_id",
            "o_custkey": "person_id",
            "o_orderstatus": "category",
            "o_orderpriority": "posting",
            "o_orderdate": "appointed_on",
        },
    )


def p2_conform_types(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    typed = conform_types(_text_orders(star), star.t("orders").schema)
    return typed.withColumnRenamed("_cast_errors", "cast_errors")


def p2_count_cast_failures(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    return count_cast_failures(_text_orders(star), star.t("orders").schema)


def p3_normalise_keys(spark: SparkSession, d: str) -> DataFrame:
    customer = Star.of(spark, d).t("customer")
    messy = customer.select(
        "c_custkey",
        F.regexp_replace("c_name", "#", "  #").alias("c_name"),
        F.lower(F.concat(F.lit("  "), "c_mktsegment", F.lit("  "))).alias("c_mktsegment"),
    )
    return normalise_keys(messy, codes=["c_mktsegment"], names=["c_name"])


def p4_decode(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    customer = star.t("customer").select("c_custkey", "c_nationkey")
    return decode(customer, "c_nationkey", star.t("nation"), "country_name", "n_nationkey", "n_name")


def p5_filter_appointments(spark: SparkSession, d: str) -> DataFrame:
    orders = Star.of(spark, d).t("orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    )
    return filter_appointments(
        orders,
        categories=["F", "O"],
        dates=("1996-01-01", "1999-01-01"),
        category_col="o_orderstatus",
        date_col="o_orderdate",
    )


def q1_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = Star.of(spark, d).t("lineitem")
    return profile(
        lines,
        key=["l_orderkey", "l_linenumber"],
        patterns={"l_returnflag": "^[ANR]$", "l_linestatus": "^[OF]$"},
        codes=["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
    )


def q2_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_keys(Star.of(spark, d).t("lineitem"), ["l_orderkey", "l_linenumber"])


def q3_unmatched_codes(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    return unmatched_codes(star.t("orders"), _customers_before(star), "o_custkey", "c_custkey")


# ---------------------------------------------------------------- J: joins


def j1_enrich(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    orders = star.t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return star.by_sender(orders).select("o_orderkey", "o_orderstatus", "n_name", "r_name")


def j2_enrich_both(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    lines = star.bilateral_lines()
    named = enrich_both(lines, star.countries(), "sender", "receiver", "n_nationkey", ["n_name", "r_name"])
    return named.select(
        "l_orderkey",
        "l_linenumber",
        "sender_n_name",
        "sender_r_name",
        "receiver_n_name",
        "receiver_r_name",
    )


def j3_active_members(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    urgent = F.col("o_orderpriority") == F.lit(URGENT)
    return active_members(star.t("customer"), star.t("orders"), "c_custkey", "o_custkey", urgent)


def j4_inactive_members(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    urgent = F.col("o_orderpriority") == F.lit(URGENT)
    return inactive_members(star.t("customer"), star.t("orders"), "c_custkey", "o_custkey", urgent)


def j5_complete(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    orders = star.t("orders")
    per_customer = orders.groupBy("o_custkey", _period()).agg(
        F.count_if(F.col("o_orderstatus") == F.lit("P")).alias("n_pending"),
        F.count_if(F.col("o_orderpriority") == F.lit(URGENT)).alias("n_urgent"),
    )
    counts = star.by_sender(per_customer).groupBy("n_name", "period").agg(
        F.sum("n_pending").alias("n_pending"), F.sum("n_urgent").alias("n_urgent")
    )
    # The period axis runs over every year between the first and the last
    # appointment (scalar subqueries), including years without any.
    lo = orders.select(F.min(F.year("o_orderdate"))).scalar()
    hi = orders.select(F.max(F.year("o_orderdate"))).scalar()
    return complete(
        counts,
        {"n_name": star.countries(), "period": F.sequence(lo, hi)},
        ["n_pending", "n_urgent"],
    )


# ---------------------------------------------------------------- A: aggregations


def a1_count_by(spark: SparkSession, d: str) -> DataFrame:
    counted = _sender_counts(Star.of(spark, d), "o_orderstatus")
    return count_by(counted, "n_name", "o_orderstatus", weight="n")


def a2_share_by(spark: SparkSession, d: str) -> DataFrame:
    return _nation_shares(Star.of(spark, d))


def a3_parity_ratio(spark: SparkSession, d: str) -> DataFrame:
    counted = _sender_counts(Star.of(spark, d), "o_orderstatus")
    return parity_ratio(counted, "n_name", "o_orderstatus", CATEGORY, OTHER, weight="n")


def a4_distinct_partners(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    partners = distinct_partners(star.bilateral_pairs(), "receiver", "sender")
    named = enrich(partners, star.countries(), "receiver", "n_nationkey", ["n_name"], prefix="receiver_")
    return named.select("receiver_n_name", "n_partners")


def a5_rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup_counts(_sender_counts(Star.of(spark, d)), ["r_name", "n_name"], weight="n")


def a6_marginals(spark: SparkSession, d: str) -> DataFrame:
    counted = _sender_counts(Star.of(spark, d), "o_orderstatus", "o_orderpriority")
    sets = [["r_name", "o_orderstatus"], ["o_orderpriority", "o_orderstatus"], ["o_orderstatus"]]
    return marginals(counted, sets, weight="n")


def a7_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return _crosstab(Star.of(spark, d))


def a8_melt(spark: SparkSession, d: str) -> DataFrame:
    return melt(_crosstab(Star.of(spark, d)), "o_orderpriority", CATEGORIES, "o_orderstatus", "n")


def a9_bilateral_matrix(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    return bilateral_matrix(
        star.bilateral_pairs(), star.countries(), "sender", "receiver", "n_nationkey", "r_name", weight="n"
    )


# ---------------------------------------------------------------- W, L: windows, top-k


def w1_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return share_of_total(_nation_counts(Star.of(spark, d)), "n", parent="r_name")


def w1_share_of_grand_total(spark: SparkSession, d: str) -> DataFrame:
    return share_of_total(count_by(Star.of(spark, d).t("orders"), "o_orderstatus"), "n")


def w2_rank_within(spark: SparkSession, d: str) -> DataFrame:
    return rank_within(_nation_counts(Star.of(spark, d)), "r_name", "n")


def _customer_orders(star: Star) -> DataFrame:
    """Orders per customer with the customer's nation name (customer grain)."""
    return star.by_sender(count_by(star.t("orders"), "o_custkey")).select("o_custkey", "n_name", "n")


def w2_rank_within_large_groups(spark: SparkSession, d: str) -> DataFrame:
    # customers within their nation: a group that grows with the data
    return rank_within(_customer_orders(Star.of(spark, d)), "n_name", "n", large_groups=True)


def w3_top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(_nation_counts(Star.of(spark, d)), "r_name", "n", 2, tie_break="n_name")


def w3_top_customers_per_nation(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(_customer_orders(Star.of(spark, d)), "n_name", "n", 3, tie_break="o_custkey")


def w4_change_over(spark: SparkSession, d: str) -> DataFrame:
    counted = _sender_counts(Star.of(spark, d), "period", "o_orderstatus")
    shares = share_by(counted, ["r_name", "period"], "o_orderstatus", CATEGORY, weight="n")
    return change_over(shares, "period", "share", partition="r_name")


def l1_top_k(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_nation_shares(Star.of(spark, d)), "share", 10, tie_break="n_name")


# ---------------------------------------------------------------- U: versions


def u1_merge_versions(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    updates = _rebalanced(star, active_members(
        star.t("customer"), star.t("orders"), "c_custkey", "o_custkey",
        F.col("o_orderstatus") == F.lit(OTHER),
    ))
    return merge_versions(_customers_before(star), updates, "c_custkey")


def u2_diff_versions(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    new = _rebalanced(star, _customers_since(star))
    return diff_versions(_customers_before(star), new, "c_custkey")


def u2_whole_row_changes(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    new = _rebalanced(star, _customers_since(star))
    return whole_row_changes(_customers_before(star), new)


def u3_maintained_counts(spark: SparkSession, d: str) -> DataFrame:
    """Subtotals by posting and category after three versions of the orders, from their differences alone.

    The second version adds later orders and settles open ones, the third
    drops some and is the last. The second batch is replayed, before and
    after the first two are folded.
    """
    keys = ["o_orderpriority", "o_orderstatus"]
    orders = Star.of(spark, d).t("orders").select("o_orderkey", "o_orderdate", *keys)
    settled = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "F").otherwise(F.col("o_orderstatus"))
    first = orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    second = orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")).withColumn("o_orderstatus", settled)
    third = orders.where(F.col("o_orderkey") % 11 != 0)
    path = shared_dir(spark, "u3-counts")
    record_changes(first.withColumn("n", F.lit(1)), path, keys, 0)
    later = signed_changes(whole_row_changes(first, second))
    record_changes(later, path, keys, 1)
    record_changes(later, path, keys, 1)
    fold_batches(spark, path, keys, 1)
    record_changes(later, path, keys, 1)
    record_changes(signed_changes(whole_row_changes(second, third)), path, keys, 2)
    return rollup_counts(maintained_counts(spark, path, keys), keys, weight="n")


# ------------------------------------- J6, W5, A10: beginnings and ends; Q4: keys

VERSION_DAYS = 14  # a version of a state that no other replaces lapses after so many days


def j6_version_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Every order with the version of its sending state valid on its date.

    The versions of a state begin on the dates of its urgent orders and lapse,
    which leaves gaps.
    """
    star = Star.of(spark, d)
    orders = enrich(
        star.t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
        star.customer_link(), "o_custkey", "c_custkey", ["c_nationkey"],
    ).withColumnRenamed("c_nationkey", "sender")
    dated = orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy("sender", F.col("o_orderdate").alias("valid_from")).agg(
        F.max("o_orderkey").alias("version")
    )
    lapses = F.col("valid_from") + F.make_dt_interval(F.lit(VERSION_DAYS))
    versions = validity(dated, "sender", "valid_from").withColumn("valid_to", F.least("valid_to", lapses))
    facts = orders.select("o_orderkey", "sender", "o_orderdate")
    return join_as_of(facts, versions, "sender", "sender", "o_orderdate", "valid_from", "valid_to")


def _postings(star: Star) -> DataFrame:
    """Lines as postings: they begin when shipped and last a day per line number."""
    lines = star.t("lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_linestatus")
    return lines.withColumn("until", F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber")))


def w5_tenure_spells(spark: SparkSession, d: str) -> DataFrame:
    return tenure_spells(_postings(Star.of(spark, d)), "l_suppkey", "l_shipdate", "until")


def a10_in_post(spark: SparkSession, d: str) -> DataFrame:
    """Lines in post per receiving state; those of status O have not ended."""
    star = Star.of(spark, d)
    posted = enrich(_postings(star), star.supplier_link(), "l_suppkey", "s_suppkey", ["s_nationkey"])
    posted = posted.withColumn("until", F.when(F.col("l_linestatus") != OTHER, F.col("until")))
    return in_post(posted.withColumnRenamed("s_nationkey", "receiver"), "receiver", "l_shipdate", "until")


def q4_keys_and_dependencies(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    found = [keys_and_dependencies(star.t(t)).select(F.lit(t).alias("table_name"), "*") for t in ("customer", "orders")]
    return found[0].unionByName(found[1])


# ---------------------------------------------------------------- Q5: suggested matches

MATCH_DISTANCE = 2  # edits between a name and its suggestion


def q5_suggested_matches(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt names without a counterpart, with every reference name within two edits.

    A reference name is a part's name and a code of its key. The other names
    are the same with up to three characters lost, added or replaced.
    """
    code = F.substr(F.md5(F.col("p_partkey").cast("string")), F.lit(1), F.lit(8))
    reference = Star.of(spark, d).t("part").select("p_partkey", F.concat("p_name", F.lit(" "), code).alias("name"))
    at = (F.col("p_partkey") % 5 + 2).cast("int")
    lost = F.concat(F.substr("name", F.lit(1), at - 1), F.substr("name", at + 1))
    added = F.concat(F.substr("name", F.lit(1), at + 3), F.lit("x"), F.substr("name", at + 4))
    replaced = F.concat(F.lit("#"), F.substr(lost, F.lit(2)))
    kinds = [F.col("name"), lost, added, replaced, F.concat(replaced, F.lit("s")), F.concat(F.lit("b"), replaced, F.lit("s"))]
    spelt = F.element_at(F.array(*kinds), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    misspelt = unmatched_codes(reference.select(spelt.alias("name")), reference, "name", "name")
    return suggested_matches(misspelt, reference, "name", "name", MATCH_DISTANCE)


# ---------------------------------------------------------------- A11: medians and quantiles

QUANTILES = (0.1, 0.5, 0.9)


def a11_share_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles, per sending state, of the share of the category among each customer's orders."""
    star = Star.of(spark, d)
    shares = share_by(star.t("orders"), "o_custkey", "o_orderstatus", CATEGORY)
    linked = enrich(shares, star.customer_link(), "o_custkey", "c_custkey", ["c_nationkey"])
    return quantiles_by(linked, "c_nationkey", "share", QUANTILES, name="share")


def a11_price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles_by(Star.of(spark, d).t("orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", QUANTILES, name="price")


# ---------------------------------------------------------------- A12: confidence intervals

REPLICATES = 200


def _orders_by_state(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    orders = star.t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return enrich(orders, star.customer_link(), "o_custkey", "c_custkey", ["c_nationkey"])


def a12_share_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Share of the category per sending state with a 95 % interval; orders are drawn."""
    return share_intervals(_orders_by_state(spark, d), "c_nationkey", "o_orderstatus", CATEGORY, "o_orderkey", replicates=REPLICATES)


def a12_parity_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of two categories per posting with a 90 % interval; customers are drawn with all their orders."""
    return share_intervals(
        _orders_by_state(spark, d), "o_orderpriority", "o_orderstatus", CATEGORY, "o_custkey", OTHER, REPLICATES, 0.9
    )


# ---------------------------------------------------------------- F1: flagship


def f1_category_share_ranking(spark: SparkSession, d: str) -> DataFrame:
    star = Star.of(spark, d)
    return category_share_ranking(
        star.t("orders"),
        star.countries(),
        key="o_custkey",
        category_col="o_orderstatus",
        category=CATEGORY,
        dim_key="n_nationkey",
        name_col="n_name",
        group_col="r_name",
        link=(star.t("customer"), "c_custkey", "c_nationkey"),
    )


QUERIES: dict[str, Query] = {
    "s1_read_delimited": s1_read_delimited,
    "s2_read_with_rejects": s2_read_with_rejects,
    "s2_load_with_rejects": s2_load_with_rejects,
    "s3_load_table": s3_load_table,
    "s4_export_feed": s4_export_feed,
    "p1_assign_names": p1_assign_names,
    "p2_conform_types": p2_conform_types,
    "p2_count_cast_failures": p2_count_cast_failures,
    "p3_normalise_keys": p3_normalise_keys,
    "p4_decode": p4_decode,
    "p5_filter_appointments": p5_filter_appointments,
    "q1_profile": q1_profile,
    "q2_duplicate_keys": q2_duplicate_keys,
    "q3_unmatched_codes": q3_unmatched_codes,
    "j1_enrich": j1_enrich,
    "j2_enrich_both": j2_enrich_both,
    "j3_active_members": j3_active_members,
    "j4_inactive_members": j4_inactive_members,
    "j5_complete": j5_complete,
    "s2_reloaded_rows": s2_reloaded_rows,
    "s3_loaded_rows": s3_loaded_rows,
    "s4_texts_round_trip": s4_texts_round_trip,
    "c1_read_countries": c1_read_countries,
    "c2_country_issues": c2_country_issues,
    "r1_share_by_state": r1_share_by_state,
    "r2_counts_with_subtotals": r2_counts_with_subtotals,
    "r3_state_by_period": r3_state_by_period,
    "r4_share_by_period": r4_share_by_period,
    "r5_parity_by_state": r5_parity_by_state,
    "a1_count_by": a1_count_by,
    "a2_share_by": a2_share_by,
    "a3_parity_ratio": a3_parity_ratio,
    "a4_distinct_partners": a4_distinct_partners,
    "a5_rollup_counts": a5_rollup_counts,
    "a6_marginals": a6_marginals,
    "a7_crosstab": a7_crosstab,
    "a8_melt": a8_melt,
    "a9_bilateral_matrix": a9_bilateral_matrix,
    "w1_share_of_total": w1_share_of_total,
    "w1_share_of_grand_total": w1_share_of_grand_total,
    "w2_rank_within": w2_rank_within,
    "w2_rank_within_large_groups": w2_rank_within_large_groups,
    "w3_top_n_per_group": w3_top_n_per_group,
    "w3_top_customers_per_nation": w3_top_customers_per_nation,
    "w4_change_over": w4_change_over,
    "l1_top_k": l1_top_k,
    "u1_merge_versions": u1_merge_versions,
    "u2_diff_versions": u2_diff_versions,
    "u2_whole_row_changes": u2_whole_row_changes,
    "u3_maintained_counts": u3_maintained_counts,
    "j6_version_as_of": j6_version_as_of,
    "w5_tenure_spells": w5_tenure_spells,
    "a10_in_post": a10_in_post,
    "q4_keys_and_dependencies": q4_keys_and_dependencies,
    "q5_suggested_matches": q5_suggested_matches,
    "a11_share_quantiles": a11_share_quantiles,
    "a11_price_quantiles": a11_price_quantiles,
    "a12_share_intervals": a12_share_intervals,
    "a12_parity_intervals": a12_parity_intervals,
    "f1_category_share_ranking": f1_category_share_ranking,
}


# ---------------------------------------------------------------- oracle SQL (DuckDB)


def _intervals_sql(group: str, unit: str, counted: str, level: float) -> str:
    """Poisson draws from 16 bits of MD5 per replicate, then the replicates' ratios by rank."""
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    draw = " + ".join(f"(u >= {math.floor(65536 * p)})::INT" for p in cdf if math.floor(65536 * p) < 65535)
    return f"""
WITH f AS (SELECT {group} AS g, CAST({unit} AS VARCHAR) AS unit, coalesce({counted}, false) AS den,
                  coalesce(o_orderstatus = '{CATEGORY}', false) AS num FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
u AS (SELECT unit, r, ('0x' || substr(md5(unit || ':' || CAST(r // 8 AS VARCHAR)), CAST(r % 8 * 4 + 1 AS INT), 4))::BIGINT AS u
      FROM (SELECT DISTINCT unit FROM f), range({REPLICATES}) t(r)),
s AS (SELECT g, r, sum(w) FILTER (num) AS num, sum(w) FILTER (den) AS den
      FROM f JOIN (SELECT unit, r, {draw} AS w FROM u) USING (unit) GROUP BY g, r),
v AS (SELECT g, list_sort(list(coalesce(num, 0)::DOUBLE / den::DOUBLE) FILTER (den > 0)) AS v FROM s GROUP BY g),
n AS (SELECT g, count(*) FILTER (den) AS n_denominator, count(*) FILTER (num) AS n_numerator FROM f GROUP BY g)
SELECT n.g AS {group}, n_denominator, n_numerator, n_numerator::DOUBLE / nullif(n_denominator, 0)::DOUBLE AS value,
       v[greatest(1, ceil(len(v) * {(1 - level) / 2!r}::DOUBLE)::INT)] AS low,
       v[greatest(1, ceil(len(v) * {(1 + level) / 2!r}::DOUBLE)::INT)] AS high, CAST(coalesce(len(v), 0) AS INTEGER) AS n_replicates
FROM n LEFT JOIN v ON v.g IS NOT DISTINCT FROM n.g"""


def _lattice_sql(table: str, columns: str) -> str:
    """Keys and dependencies of a table from the distinct rows of every column set, named by bit masks."""
    names = columns.split()
    sets = [[i for i in range(len(names)) if mask >> i & 1] for mask in range(1 << len(names))]
    counts = " UNION ALL ".join(
        f"SELECT {mask} AS m, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(names[i] for i in s) or '1'} FROM {table})) AS d, "
        f"'{','.join(names[i] for i in s)}' AS label"
        for mask, s in enumerate(sets)
    )
    bits = ", ".join(f"({1 << i}, '{n}')" for i, n in enumerate(names))
    return f"""
WITH c AS ({counts}), b(bit, name) AS (VALUES {bits}),
k AS (SELECT m, label FROM c WHERE d = (SELECT count(*) FROM {table})),
f AS (SELECT c.m, c.label, b.bit, b.name FROM c JOIN b ON c.m & b.bit = 0 JOIN c w ON w.m = c.m + b.bit WHERE w.d = c.d)
SELECT '{table}' AS table_name, 'key' AS kind, label AS columns, NULL AS determines FROM k
WHERE NOT EXISTS (SELECT 1 FROM k s WHERE s.m <> k.m AND s.m & k.m = s.m)
UNION ALL
SELECT '{table}', 'dependency', label, name FROM f
WHERE NOT EXISTS (SELECT 1 FROM f s WHERE s.bit = f.bit AND s.m <> f.m AND s.m & f.m = s.m)"""



_COUNTRIES = (
    "countries AS (SELECT n_nationkey, n_name, r_name "
    "FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"
)
_BY_SENDER = (
    "orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN countries ON c_nationkey = n_nationkey"
)
_LINES = f"""{_COUNTRIES},
s AS (SELECT o_orderkey, c_nationkey AS sender FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
r AS (SELECT l_orderkey, l_linenumber, s_nationkey AS receiver FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
lines AS (SELECT r.l_orderkey, r.l_linenumber, s.sender, r.receiver FROM r LEFT JOIN s ON r.l_orderkey = s.o_orderkey)"""
_SHARE = (
    "count(o_orderstatus) AS n_total, "
    "count(*) FILTER (WHERE o_orderstatus = 'F') AS n_category, "
    "CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) "
    "/ NULLIF(CAST(count(o_orderstatus) AS DOUBLE), 0) AS share"
)
_NATION_SHARES = f"WITH {_COUNTRIES}, sh AS (SELECT n_name, {_SHARE} FROM {_BY_SENDER} GROUP BY n_name)"
_NATION_COUNTS = (
    f"WITH {_COUNTRIES}, c AS (SELECT r_name, n_name, count(*) AS n FROM {_BY_SENDER} GROUP BY r_name, n_name)"
)
_CROSSTAB = (
    "SELECT o_orderpriority, "
    "count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", "
    "count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" "
    "FROM orders GROUP BY o_orderpriority"
)
_VERSIONS = """old_v AS (SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o
    WHERE o.o_custkey = c.c_custkey AND o.o_orderdate < TIMESTAMP '1997-01-01')),
since AS (SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o
    WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1997-01-01')),
open_o AS (SELECT o_custkey, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey),
new_v AS (SELECT c_custkey, c_name, c_nationkey,
    CASE WHEN n_open IS NOT NULL THEN c_acctbal - CAST(n_open * 100 AS DOUBLE) ELSE c_acctbal END AS c_acctbal,
    c_mktsegment FROM since LEFT JOIN open_o ON c_custkey = o_custkey)"""

ORACLE: dict[str, str] = {
    "s1_read_delimited": "SELECT * FROM customer",
    "s2_read_with_rejects": """
SELECT o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN 'bad o_totalprice' END AS _reject_reason,
       count(*) AS n
FROM orders GROUP BY ALL""",
    "s2_load_with_rejects": """
SELECT o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN 'bad o_totalprice' END AS _reject_reason,
       count(*) AS n
FROM orders GROUP BY ALL""",
    "s3_load_table": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus, o_orderpriority, count(*) AS n
FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus IN ('F', 'O')
GROUP BY ALL""",
    "s4_export_feed": _CROSSTAB,
    "p1_assign_names": """
SELECT o_orderkey AS appointment_id, o_custkey AS person_id, o_orderstatus AS category,
       o_orderdate AS appointed_on, o_orderpriority AS posting, o_totalprice
FROM orders""",
    "p2_conform_types": """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority,
       CASE WHEN o_orderstatus = 'P' THEN 'o_totalprice' ELSE '' END AS cast_errors
FROM orders""",
    "p2_count_cast_failures": """
SELECT 'o_totalprice' AS column_name, count(*) AS n_failed
FROM orders WHERE o_orderstatus = 'P'""",
    "p3_normalise_keys": """
SELECT c_custkey, replace(c_name, '#', ' #') AS c_name, upper(c_mktsegment) AS c_mktsegment
FROM customer""",
    "p4_decode": """
SELECT c_custkey, c_nationkey, n_name AS country_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "p5_filter_appointments": """
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate
FROM orders
WHERE o_orderstatus IN ('F', 'O')
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""",
    "q1_profile": """
SELECT 'l_orderkey' AS column_name, count(*) AS n_rows, count(*) - count(l_orderkey) AS n_nulls,
       count(DISTINCT l_orderkey) AS n_distinct, CAST(NULL AS BIGINT) AS n_pattern_miss FROM lineitem
UNION ALL
SELECT 'l_partkey', count(*), count(*) - count(l_partkey), count(DISTINCT l_partkey),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_suppkey', count(*), count(*) - count(l_suppkey), count(DISTINCT l_suppkey),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_linenumber', count(*), count(*) - count(l_linenumber), count(DISTINCT l_linenumber),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_quantity', count(*), count(*) - count(l_quantity), count(DISTINCT l_quantity),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_extendedprice', count(*), count(*) - count(l_extendedprice), count(DISTINCT l_extendedprice),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_discount', count(*), count(*) - count(l_discount), count(DISTINCT l_discount),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_tax', count(*), count(*) - count(l_tax), count(DISTINCT l_tax),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), count(DISTINCT l_returnflag),
       count(*) FILTER (WHERE NOT regexp_matches(l_returnflag, '^[ANR]$')) FROM lineitem
UNION ALL
SELECT 'l_linestatus', count(*), count(*) - count(l_linestatus), count(DISTINCT l_linestatus),
       count(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^[OF]$')) FROM lineitem
UNION ALL
SELECT 'l_shipdate', count(*), count(*) - count(l_shipdate), count(DISTINCT l_shipdate),
       CAST(NULL AS BIGINT) FROM lineitem
UNION ALL
SELECT 'key(l_orderkey,l_linenumber)', count(*), CAST(NULL AS BIGINT),
       count(DISTINCT (l_orderkey, l_linenumber)), CAST(NULL AS BIGINT) FROM lineitem""",
    "q2_duplicate_keys": """
SELECT l_orderkey, l_linenumber, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "q3_unmatched_codes": """
SELECT o_custkey, count(*) AS n
FROM orders o
WHERE NOT EXISTS (
  SELECT 1 FROM customer c
  WHERE c.c_custkey = o.o_custkey
    AND EXISTS (SELECT 1 FROM orders x
                WHERE x.o_custkey = c.c_custkey AND x.o_orderdate < TIMESTAMP '1997-01-01'))
GROUP BY o_custkey""",
    "j1_enrich": f"""
WITH {_COUNTRIES}
SELECT o_orderkey, o_orderstatus, n_name, r_name FROM {_BY_SENDER}""",
    "j2_enrich_both": f"""
WITH {_LINES}
SELECT l_orderkey, l_linenumber,
       sc.n_name AS sender_n_name, sc.r_name AS sender_r_name,
       rc.n_name AS receiver_n_name, rc.r_name AS receiver_r_name
FROM lines
LEFT JOIN countries sc ON lines.sender = sc.n_nationkey
LEFT JOIN countries rc ON lines.receiver = rc.n_nationkey""",
    "j3_active_members": """
SELECT * FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "j4_inactive_members": """
SELECT * FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "j5_complete": f"""
WITH {_COUNTRIES},
c AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS period,
             count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending,
             count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent
      FROM {_BY_SENDER} GROUP BY ALL),
y AS (SELECT CAST(unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders),
                                         (SELECT max(year(o_orderdate)) FROM orders))) AS INTEGER) AS period),
g AS (SELECT DISTINCT n_name FROM countries)
SELECT CASE WHEN k.inside THEN k.n_name ELSE c.n_name END AS n_name, CASE WHEN k.inside THEN k.period ELSE c.period END AS period,
       CAST(coalesce(c.n_pending, 0) AS BIGINT) AS n_pending,
       CAST(coalesce(c.n_urgent, 0) AS BIGINT) AS n_urgent
FROM (SELECT g.n_name, y.period, true AS inside FROM g CROSS JOIN y) k
FULL JOIN c ON c.n_name = k.n_name AND c.period = k.period""",
    "a1_count_by": f"""
WITH {_COUNTRIES}
SELECT n_name, o_orderstatus, count(*) AS n FROM {_BY_SENDER} GROUP BY ALL""",
    "a2_share_by": f"{_NATION_SHARES} SELECT * FROM sh",
    "a3_parity_ratio": f"""
WITH {_COUNTRIES}
SELECT n_name,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_numerator,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS n_denominator,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)
         / NULLIF(CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE), 0) AS ratio
FROM {_BY_SENDER} GROUP BY n_name""",
    "a4_distinct_partners": f"""
WITH {_LINES}
SELECT rc.n_name AS receiver_n_name, count(DISTINCT lines.sender) AS n_partners
FROM lines LEFT JOIN countries rc ON lines.receiver = rc.n_nationkey
GROUP BY lines.receiver, rc.n_name""",
    "a5_rollup_counts": f"""
WITH {_COUNTRIES}
SELECT r_name, n_name, count(*) AS n,
       CAST(grouping(r_name) AS INTEGER) AS g_r_name, CAST(grouping(n_name) AS INTEGER) AS g_n_name
FROM {_BY_SENDER} GROUP BY ROLLUP (r_name, n_name)""",
    "a6_marginals": f"""
WITH {_COUNTRIES}
SELECT r_name, o_orderstatus, o_orderpriority, count(*) AS n,
       CAST(grouping(r_name) AS INTEGER) AS g_r_name,
       CAST(grouping(o_orderstatus) AS INTEGER) AS g_o_orderstatus,
       CAST(grouping(o_orderpriority) AS INTEGER) AS g_o_orderpriority
FROM {_BY_SENDER}
GROUP BY GROUPING SETS ((r_name, o_orderstatus), (o_orderpriority, o_orderstatus), (o_orderstatus))""",
    "a7_crosstab": _CROSSTAB,
    "a8_melt": f"""
WITH t AS ({_CROSSTAB})
UNPIVOT t ON "F", "O", "P" INTO NAME o_orderstatus VALUE n""",
    "a9_bilateral_matrix": f"""
WITH {_LINES}
SELECT sc.r_name AS sender_r_name, rc.r_name AS receiver_r_name, count(*) AS n
FROM lines
LEFT JOIN countries sc ON lines.sender = sc.n_nationkey
LEFT JOIN countries rc ON lines.receiver = rc.n_nationkey
GROUP BY ALL""",
    "w1_share_of_total": f"""
{_NATION_COUNTS}
SELECT r_name, n_name, n,
       CAST(n AS DOUBLE) / NULLIF(CAST(sum(n) OVER (PARTITION BY r_name) AS DOUBLE), 0) AS share
FROM c""",
    "w1_share_of_grand_total": """
SELECT o_orderstatus, count(*) AS n,
       CAST(count(*) AS DOUBLE) / NULLIF(CAST((SELECT count(*) FROM orders) AS DOUBLE), 0) AS share
FROM orders GROUP BY o_orderstatus""",
    "w2_rank_within": f"""
{_NATION_COUNTS}
SELECT r_name, n_name, n,
       CAST(dense_rank() OVER (PARTITION BY r_name ORDER BY n DESC) AS INTEGER) AS rank
FROM c""",
    "w2_rank_within_large_groups": f"""
WITH {_COUNTRIES},
c AS (SELECT o_custkey, n_name, count(*) AS n FROM {_BY_SENDER} GROUP BY o_custkey, n_name)
SELECT o_custkey, n_name, n,
       CAST(dense_rank() OVER (PARTITION BY n_name ORDER BY n DESC) AS INTEGER) AS rank
FROM c""",
    "w3_top_customers_per_nation": f"""
WITH {_COUNTRIES},
c AS (SELECT o_custkey, n_name, count(*) AS n FROM {_BY_SENDER} GROUP BY o_custkey, n_name)
SELECT * FROM (
  SELECT o_custkey, n_name, n,
         CAST(row_number() OVER (PARTITION BY n_name ORDER BY n DESC, o_custkey) AS INTEGER) AS position
  FROM c)
WHERE position <= 3""",
    "w3_top_n_per_group": f"""
{_NATION_COUNTS}
SELECT * FROM (
  SELECT r_name, n_name, n,
         CAST(row_number() OVER (PARTITION BY r_name ORDER BY n DESC, n_name) AS INTEGER) AS position
  FROM c)
WHERE position <= 2""",
    "w4_change_over": f"""
WITH {_COUNTRIES},
c AS (SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS period, {_SHARE}
      FROM {_BY_SENDER} GROUP BY ALL)
SELECT c.*, p.share AS previous, c.share - p.share AS change
FROM c LEFT JOIN c p ON p.r_name IS NOT DISTINCT FROM c.r_name AND p.period + 1 = c.period""",
    "l1_top_k": f"""
{_NATION_SHARES}
SELECT * FROM sh ORDER BY share DESC NULLS LAST, n_name LIMIT 10""",
    "u1_merge_versions": """
WITH old_v AS (SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o
    WHERE o.o_custkey = c.c_custkey AND o.o_orderdate < TIMESTAMP '1997-01-01')),
open_o AS (SELECT o_custkey, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey),
upd AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal - CAST(n_open * 100 AS DOUBLE) AS c_acctbal, c_mktsegment
        FROM customer JOIN open_o ON c_custkey = o_custkey)
SELECT * FROM upd
UNION ALL
SELECT * FROM old_v WHERE c_custkey NOT IN (SELECT c_custkey FROM upd)""",
    "u2_diff_versions": f"""
WITH {_VERSIONS}
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
       CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
       o.c_name AS old_c_name, o.c_nationkey AS old_c_nationkey, o.c_acctbal AS old_c_acctbal,
       o.c_mktsegment AS old_c_mktsegment,
       n.c_name AS new_c_name, n.c_nationkey AS new_c_nationkey, n.c_acctbal AS new_c_acctbal,
       n.c_mktsegment AS new_c_mktsegment
FROM old_v o FULL OUTER JOIN new_v n ON o.c_custkey = n.c_custkey
WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL
   OR o.c_name IS DISTINCT FROM n.c_name OR o.c_nationkey IS DISTINCT FROM n.c_nationkey
   OR o.c_acctbal IS DISTINCT FROM n.c_acctbal OR o.c_mktsegment IS DISTINCT FROM n.c_mktsegment""",
    "u2_whole_row_changes": f"""
WITH {_VERSIONS}
SELECT *, 'old' AS side, count(*) AS n FROM (SELECT * FROM old_v EXCEPT ALL SELECT * FROM new_v) GROUP BY ALL
UNION ALL
SELECT *, 'new' AS side, count(*) AS n FROM (SELECT * FROM new_v EXCEPT ALL SELECT * FROM old_v) GROUP BY ALL""",
    "u3_maintained_counts": """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping(o_orderpriority) AS INTEGER) AS g_o_orderpriority,
       CAST(grouping(o_orderstatus) AS INTEGER) AS g_o_orderstatus
FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
    "j6_version_as_of": f"""
WITH f AS (SELECT o_orderkey, c_nationkey AS sender, o_orderdate, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
s AS (SELECT sender, o_orderdate AS valid_from, max(o_orderkey) AS version FROM f WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
v AS (SELECT *, least(lead(valid_from) OVER (PARTITION BY sender ORDER BY valid_from),
                      valid_from + INTERVAL {VERSION_DAYS} DAY) AS valid_to FROM s),
j AS (SELECT f.o_orderkey, f.sender, f.o_orderdate, v.valid_from, v.version, v.valid_to
      FROM f ASOF LEFT JOIN v ON f.sender = v.sender AND f.o_orderdate >= v.valid_from)
SELECT o_orderkey, sender, o_orderdate, CASE WHEN o_orderdate < valid_to THEN valid_from END AS valid_from,
       CASE WHEN o_orderdate < valid_to THEN version END AS version, CASE WHEN o_orderdate < valid_to THEN valid_to END AS valid_to
FROM j""",
    "w5_tenure_spells": """
WITH p AS (SELECT l_suppkey, l_shipdate AS b, l_shipdate + to_days(l_linenumber) AS e, count(*) AS c FROM lineitem GROUP BY ALL),
r AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM p),
s AS (SELECT *, sum((reached IS NULL OR b > reached)::INT) OVER (PARTITION BY l_suppkey ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS spell
      FROM r)
SELECT l_suppkey, min(b) AS spell_start, max(e) AS spell_end, CAST(sum(c) AS BIGINT) AS n_postings FROM s GROUP BY l_suppkey, spell""",
    "a10_in_post": """
WITH p AS (SELECT s_nationkey AS receiver, l_shipdate AS b,
                  CASE WHEN l_linestatus <> 'O' THEN l_shipdate + to_days(l_linenumber) END AS e
           FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
t AS (SELECT receiver, b AS at FROM p UNION SELECT receiver, e FROM p WHERE e IS NOT NULL),
q AS (SELECT receiver, b, e, count(*) AS n FROM p GROUP BY ALL)
SELECT t.receiver, t.at, CAST(coalesce(sum(n) FILTER (b = t.at), 0) AS BIGINT) AS n_begin,
       CAST(coalesce(sum(n) FILTER (e = t.at), 0) AS BIGINT) AS n_end,
       CAST(coalesce(sum(n) FILTER (b <= t.at AND (e IS NULL OR e > t.at)), 0) AS BIGINT) AS n_in_post
FROM t JOIN q ON q.receiver IS NOT DISTINCT FROM t.receiver GROUP BY t.receiver, t.at""",
    "q4_keys_and_dependencies": " UNION ALL ".join(
        f"SELECT * FROM ({_lattice_sql(t, c)})"
        for t, c in (
            ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
            ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
        )
    ),
    "q5_suggested_matches": f"""
WITH r AS (SELECT p_partkey AS k, p_name || ' ' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS name FROM part),
l AS (SELECT k, name, substr(name, 1, k % 5 + 1) || substr(name, k % 5 + 3) AS lost FROM r),
m AS (SELECT DISTINCT CASE k % 6 WHEN 0 THEN name WHEN 1 THEN lost
        WHEN 2 THEN substr(name, 1, k % 5 + 5) || 'x' || substr(name, k % 5 + 6)
        WHEN 3 THEN '#' || substr(lost, 2) WHEN 4 THEN '#' || substr(lost, 2) || 's'
        ELSE 'b#' || substr(lost, 2) || 's' END AS name FROM l),
u AS (SELECT name FROM m WHERE name NOT IN (SELECT name FROM r))
SELECT u.name, b.name AS suggestion, CAST(levenshtein(u.name, b.name) AS INTEGER) AS distance
FROM u JOIN (SELECT DISTINCT name FROM r) b ON levenshtein(u.name, b.name) <= {MATCH_DISTANCE}""",
    "a11_share_quantiles": f"""
WITH s AS (SELECT o_custkey, {_SHARE} FROM orders GROUP BY o_custkey),
l AS (SELECT c_nationkey, share FROM s LEFT JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, 0.1::DOUBLE AS quantile, quantile_disc(share, 0.1) AS share, count(share) AS n FROM l GROUP BY c_nationkey
UNION ALL SELECT c_nationkey, 0.5::DOUBLE, quantile_disc(share, 0.5), count(share) FROM l GROUP BY c_nationkey
UNION ALL SELECT c_nationkey, 0.9::DOUBLE, quantile_disc(share, 0.9), count(share) FROM l GROUP BY c_nationkey""",
    "a11_price_quantiles": " UNION ALL ".join(
        f"SELECT o_orderstatus, o_orderpriority, {q}::DOUBLE AS quantile, quantile_disc(o_totalprice, {q}) AS price, "
        "count(o_totalprice) AS n FROM orders GROUP BY ALL"
        for q in QUANTILES
    ),
    "a12_share_intervals": _intervals_sql("c_nationkey", "o_orderkey", "o_orderstatus IS NOT NULL", 0.95),
    "a12_parity_intervals": _intervals_sql("o_orderpriority", "o_custkey", f"o_orderstatus = '{OTHER}'", 0.9),
    "f1_category_share_ranking": f"""
WITH {_COUNTRIES},
sh AS (SELECT r_name, n_name, {_SHARE} FROM {_BY_SENDER} GROUP BY r_name, n_name)
SELECT r_name, n_name, n_total, n_category, share,
       CASE WHEN r_name IS NOT NULL THEN
         CAST(dense_rank() OVER (PARTITION BY r_name ORDER BY share DESC) AS INTEGER) END AS rank
FROM sh""",
    "s2_reloaded_rows": """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       CASE WHEN o_orderstatus = 'P' THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
       CASE WHEN o_orderstatus = 'P' THEN 'bad o_totalprice' END AS _reject_reason
FROM orders""",
    "s3_loaded_rows": "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders",
    "s4_texts_round_trip": r"""
SELECT c_custkey, CASE c_custkey % 6
    WHEN 0 THEN 'say "' || c_name || '" ok' WHEN 1 THEN '  a;b ' || c_name || '  '
    WHEN 2 THEN c_name || chr(10) || c_mktsegment WHEN 3 THEN '' WHEN 4 THEN 'back\slash ' || c_name END AS text
FROM customer""",
    "c1_read_countries": """
SELECT upper(substr(n_name, 1, 3)) AS country_code, n_name AS country_name, CAST(n_regionkey AS INTEGER) AS continent_code FROM nation""",
    "c2_country_issues": """
WITH n AS (SELECT upper(substr(n_name, 1, 3)) AS code, n_name AS name, n_regionkey AS r FROM nation)
SELECT code AS country_code, 'code pattern' AS issue, count(*) AS n FROM n WHERE NOT regexp_matches(code, '^[A-Z]{3}$') GROUP BY code
UNION ALL SELECT code, 'unknown continent', count(*) FROM n WHERE r NOT BETWEEN 2 AND 8 GROUP BY code
UNION ALL SELECT code, 'repeated code', count(*) FROM n GROUP BY code HAVING count(*) > 1
UNION ALL SELECT min(code), 'repeated name', count(*) FROM n GROUP BY name HAVING count(*) > 1""",
    "r1_share_by_state": f"""
WITH {_COUNTRIES},
sh AS (SELECT r_name, n_name, {_SHARE} FROM {_BY_SENDER} GROUP BY r_name, n_name)
SELECT r_name, n_name, n_total, n_category, share,
       CASE WHEN r_name IS NOT NULL THEN
         CAST(dense_rank() OVER (PARTITION BY r_name ORDER BY share DESC) AS INTEGER) END AS rank
FROM sh""",
    "r2_counts_with_subtotals": f"""
{_NATION_COUNTS}
SELECT r_name, n_name, CAST(sum(n) AS BIGINT) AS n,
       CAST(grouping(r_name) AS INTEGER) AS g_r_name, CAST(grouping(n_name) AS INTEGER) AS g_n_name
FROM c GROUP BY ROLLUP (r_name, n_name)""",
    "r3_state_by_period": f"""
WITH {_COUNTRIES},
c AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS n FROM {_BY_SENDER} GROUP BY ALL),
y AS (SELECT CAST(unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders),
                                         (SELECT max(year(o_orderdate)) FROM orders))) AS INTEGER) AS period),
k AS (SELECT n_name, period, true AS inside FROM (SELECT DISTINCT n_name FROM countries) CROSS JOIN y)
SELECT CASE WHEN k.inside THEN k.n_name ELSE c.n_name END AS n_name, CASE WHEN k.inside THEN k.period ELSE c.period END AS period,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM k FULL JOIN c ON c.n_name = k.n_name AND c.period = k.period""",
    "r4_share_by_period": f"""
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS period, {_SHARE} FROM orders GROUP BY ALL)
SELECT s.*, p.share AS previous, s.share - p.share AS change FROM s LEFT JOIN s p ON p.period = s.period - 1""",
    "r5_parity_by_state": f"""
WITH {_COUNTRIES}
SELECT n_name, r_name,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_numerator,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS n_denominator,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)
         / NULLIF(CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE), 0) AS ratio
FROM {_BY_SENDER} GROUP BY n_name, r_name""",
}

