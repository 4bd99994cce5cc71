"""Exact medians and quantiles per group by histogram selection.

Values are counted first, so ties and a hot group collapse in the map tasks.
Each round deals the values that can still be the answer into buckets between
the smallest and the largest of them and goes on in the bucket that holds the
wanted rank: no group is ever sorted, and a round moves at most one row per
group, bucket and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legation.session import shared_dir

BUCKETS = 1024
BROADCAST_ROWS = 100_000  # wanted ranks (some 60 bytes each) that are broadcast; more are joined by shuffle


def quantiles_by(
    df: DataFrame,
    group: str | Sequence[str],
    value: str,
    quantiles: Sequence[float] = (0.5,),
    quantile_name: str = "quantile",
    name: str = "value",
    count_name: str = "n",
) -> DataFrame:
    """For each group and quantile q the least value that a share q of the values does not exceed.

    One row per group and quantile with the number of values. It is always a
    value that occurs, as a double: the one at rank ceil(q n), 1 at least.
    Nulls are not counted, a group without values has no row; NaN is above
    all other values; a null group is a group.
    """
    groups = [group] if isinstance(group, str) else list(group)
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    shared_dir(df.sparkSession, "quantiles")  # makes sure a checkpoint folder is set
    keys = [f"__g{i}" for i in range(len(groups))]
    values = df.where(F.col(value).isNotNull()).select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)], (F.col(value).cast("double") + 0.0).alias("__v")
    )
    counted = values.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")).checkpoint(eager=True)

    q, n = F.col("__q"), F.col("__all")
    rank = F.greatest(F.lit(1.0), n - F.floor(n - q * n)).cast("long")
    wanted = counted.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = wanted.withColumn("__q", F.explode(F.array(*[F.lit(float(x)) for x in quantiles]))).withColumn("__rank", rank)
    wanted = wanted.checkpoint(eager=True)
    done: DataFrame | None = None
    while True:
        # NaN equals itself here.
        found = wanted.where(F.col("__lo") == F.col("__hi"))
        done = found if done is None else done.unionByName(found)
        wanted = wanted.where(F.col("__lo") != F.col("__hi"))
        open_ = wanted.count()
        if not open_:
            break
        wanted = _narrowed(counted, wanted, keys, broadcast=open_ <= BROADCAST_ROWS)
    return done.select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys)],
        F.col("__q").alias(quantile_name), F.col("__lo").alias(name), F.col("__all").alias(count_name),
    )


def _narrowed(counted: DataFrame, wanted: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """``wanted`` within the bucket that holds its rank."""
    side = wanted.select(*[F.col(k).alias(f"__w{k}") for k in keys], "__all", "__q", "__rank", "__lo", "__hi")
    side = F.broadcast(side) if broadcast else side
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    same = [counted[k].eqNullSafe(F.col(f"__w{k}")) for k in keys]
    near = counted.join(side, [*same, (v >= lo) & (v <= hi)])
    # The smallest falls into the first bucket and the largest into the last, so every round parts them.
    endless = F.lit(float("inf"))
    part = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * (BUCKETS - 1))
    bucket = (
        F.when(v == lo, 0).when(v == hi, BUCKETS + 1)
        # Between infinite ends the values are parted by sign, then by their own ends.
        .when((lo == -endless) | (hi == endless) | F.isnan(hi), F.when(F.isnan(v) | (v == endless), BUCKETS).otherwise(1))
        .otherwise(F.greatest(F.lit(1), F.least(part, F.lit(BUCKETS))))
    )
    facts = [*keys, "__q", "__rank", "__all"]
    sums = near.groupBy(*facts, bucket.alias("__bucket")).agg(F.sum("__n").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    running = Window.partitionBy(*facts).orderBy("__bucket")  # BUCKETS + 2 rows at most
    upto = sums.withColumn("__upto", F.sum("__n").over(running))
    hit = upto.where("__upto >= __rank").groupBy(*facts).agg(F.min(F.struct("__bucket", "__upto", "__n", "__lo", "__hi")).alias("b"))
    left = (F.col("__rank") - F.col("b.__upto") + F.col("b.__n")).alias("__rank")
    return hit.select(*keys, "__all", F.col("b.__lo").alias("__lo"), F.col("b.__hi").alias("__hi"), "__q", left).checkpoint(eager=True)
