"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reached) for every node of ``links``.

    Every round gives each node the smallest label among its own and its
    neighbours', then follows the label of that label (pointer jumping), so
    rounds grow with the logarithm of the longest chain. Labels live in the
    shared checkpoint folder; only one counter per round reaches the driver.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.union(both.select("other", "node")).distinct(), narrow=True)
    labels = cut(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), narrow=True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lowered = cut(lowered, narrow=True)
        jump = lowered.select(F.col("node").alias("at"), F.col("component").alias("next"))
        stepped = cut(
            lowered.join(jump, lowered["component"] == jump["at"])
            .select("node", F.col("next").alias("component"), (F.col("next") != F.col("was")).alias("moved")),
            narrow=True,
        )
        labels = stepped.select("node", "component")
        if stepped.filter("moved").isEmpty():
            return labels
