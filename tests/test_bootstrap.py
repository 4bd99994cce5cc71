"""Poisson bootstrap against plain Python on the same draws."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from legation.operators import share_intervals
from legation.operators.bootstrap import poisson_thresholds

SCHEMA = "id string, state string, category string"


def weight(unit, replicate):
    h = hashlib.md5(f"{unit}:{replicate // 8}".encode()).hexdigest()
    u = int(h[replicate % 8 * 4 : replicate % 8 * 4 + 4], 16)
    return sum(u >= t for t in poisson_thresholds())


def brute(data, category, against, replicates, level, unit=0):
    out = {}
    for g in {r[1] for r in data}:
        den = [r[unit] or "" for r in data if r[1] == g and (r[2] is not None if against is None else r[2] == against)]
        num = [r[unit] or "" for r in data if r[1] == g and r[2] == category]
        values = []
        for k in range(replicates):
            d = sum(weight(u, k) for u in den)
            if d:
                values.append(sum(weight(u, k) for u in num) / d)
        values.sort()
        m = len(values)
        pick = lambda q: values[max(1, math.ceil(m * q)) - 1] if m else None
        out[g] = (len(den), len(num), len(num) / len(den) if den else None, pick((1 - level) / 2), pick((1 + level) / 2), m)
    return out


def got(df, *args, **more):
    return {r[0]: tuple(r)[1:] for r in share_intervals(df, "state", "category", *args, **more).collect()}


def rows(n=150, seed=3):
    r = random.Random(seed)
    data = [(f"k{i}", r.choice(["hot", "hot", "a", None]), r.choice(["W", "M", "M", "O", None])) for i in range(n)]
    return data + [("n1", "nulls", None), ("one", "one", "W"), (None, "a", "W"), (None, "a", "M"), ("k1", "a", "W")]


@pytest.mark.parametrize("against,replicates,level", [(None, 40, 0.95), ("M", 40, 0.9), ("absent", 8, 0.5)])
def test_equals_plain_python(spark, against, replicates, level):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data, "W", against, replicates, level)
    assert got(df, "W", "id", against, replicates, level) == want
    assert got(df.repartition(5), "W", "id", against, replicates, level) == want


def test_units_drawn_together(spark):
    """Named by state, all rows of a state share each draw: its share never moves."""
    data = rows()
    out = got(spark.createDataFrame(data, SCHEMA), "W", "state", replicates=40)
    assert out == brute(data, "W", None, 40, 0.95, unit=1)
    assert out["hot"][2] == pytest.approx(out["hot"][3]) == pytest.approx(out["hot"][4])


def test_width_agrees_with_theory(spark):
    """A third of all rows in one group: the interval has the binomial standard error's width."""
    n = 30_000
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("state"),
        F.when(F.md5(F.col("id").cast("string")) < "4", "W").otherwise("M").alias("category"),
    )
    total, _, share, low, high, m = got(df, "W", "id")["hot"]
    assert total == n // 3 and m == 200 and low < share < high
    assert (high - low) / (2 * 1.96 * math.sqrt(share * (1 - share) / total)) == pytest.approx(1, abs=0.2)


def test_draws_have_mean_and_variance_one():
    bounds = [0, *poisson_thresholds(), 65536]
    p = [(b - a) / 65536 for a, b in zip(bounds, bounds[1:])]
    mean = sum(k * x for k, x in enumerate(p))
    assert mean == pytest.approx(1, abs=1e-3)
    assert sum((k - mean) ** 2 * x for k, x in enumerate(p)) == pytest.approx(1, abs=1e-3)


def test_empty_and_wrong_parameters(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(df, "W", "id") == {}
    for more in ({"replicates": 12}, {"replicates": 0}, {"level": 1.0}):
        with pytest.raises(ValueError):
            share_intervals(df, "state", "category", "W", "id", **more)
