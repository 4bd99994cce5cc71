"""The stand-in star over the driver's tables.

No appointment data ships with the test tables, so the shape is borrowed:

* an appointment is an ``orders`` row; its category is ``o_orderstatus``
  (three values), its posting type ``o_orderpriority`` and its period
  ``year(o_orderdate)``;
* the sending state is the nation of the ordering customer;
* the receiving state (bilateral) is the nation of the supplier of each
  ``lineitem`` of the order;
* the continent is the nation's region.

Customer-level facts are counted at the grain of the join key *before*
joining: a join then moves one row per key instead of one per fact, and a key
that holds a third of the facts is collapsed by the partial aggregation in
each map task. Lines meet their orders line by line and are counted per pair
of states afterwards: nearly every (order, receiver) pair is distinct, so
counting them first would save nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legation.operators.joins import enrich
from legation.sources.tables import read_parquet_table


class Star:
    """Handles on the driver tables of one scale, plus derived building blocks.

    Every query makes its own (``Star.of``), so a folder that was rewritten in
    the meantime is listed anew.
    """

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Star:
        return cls(spark, sf_dir)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._countries: DataFrame | None = None
        self._customer_link: DataFrame | None = None
        self._supplier_link: DataFrame | None = None

    def t(self, name: str) -> DataFrame:
        """The table ``name``; the same DataFrame object for every call."""
        if name not in self._tables:
            self._tables[name] = read_parquet_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    def countries(self) -> DataFrame:
        """Country dimension: ``n_nationkey, n_name, r_name`` (continent)."""
        if self._countries is None:
            nation = self.t("nation").select("n_nationkey", "n_name", "n_regionkey")
            named = enrich(nation, self.t("region"), "n_regionkey", "r_regionkey", ["r_name"])
            self._countries = named.drop("n_regionkey")
        return self._countries

    def customer_link(self) -> DataFrame:
        """``c_custkey, c_nationkey``: the customer-to-state bridge."""
        if self._customer_link is None:
            self._customer_link = self.t("customer").select("c_custkey", "c_nationkey")
        return self._customer_link

    def supplier_link(self) -> DataFrame:
        """``s_suppkey, s_nationkey``: the supplier-to-state bridge."""
        if self._supplier_link is None:
            self._supplier_link = self.t("supplier").select("s_suppkey", "s_nationkey")
        return self._supplier_link

    def by_sender(self, counted: DataFrame, cust_col: str = "o_custkey") -> DataFrame:
        """Add the sending state (``c_nationkey, n_name, r_name``) to customer-grain rows."""
        linked = enrich(counted, self.customer_link(), cust_col, "c_custkey", ["c_nationkey"])
        return enrich(linked, self.countries(), "c_nationkey", "n_nationkey", ["n_name", "r_name"])

    def order_senders(self) -> DataFrame:
        """``o_orderkey, sender`` (nation key of the ordering customer)."""
        orders = self.t("orders").select("o_orderkey", "o_custkey")
        linked = enrich(orders, self.customer_link(), "o_custkey", "c_custkey", ["c_nationkey"])
        return linked.select("o_orderkey", F.col("c_nationkey").alias("sender"))

    def line_receivers(self) -> DataFrame:
        """``l_orderkey, l_linenumber, receiver`` (nation key of each line's supplier)."""
        lines = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        linked = enrich(lines, self.supplier_link(), "l_suppkey", "s_suppkey", ["s_nationkey"])
        return linked.select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("receiver"))

    def bilateral_lines(self) -> DataFrame:
        """One row per line: ``l_orderkey, l_linenumber, sender, receiver``."""
        senders = self.order_senders()
        lines = self.line_receivers()
        joined = lines.join(senders, lines["l_orderkey"] == senders["o_orderkey"], "left")
        return joined.select("l_orderkey", "l_linenumber", "sender", "receiver")

    def bilateral_pairs(self) -> DataFrame:
        """``sender, receiver, n``: lines counted per pair of states."""
        lines = self.bilateral_lines()
        return lines.groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("n"))
