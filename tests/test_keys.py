"""Keys and functional dependencies against a search over all column sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from legation.operators import keys as keys_module
from legation.operators import keys_and_dependencies


def brute(data, names):
    def classes(s):
        return len({tuple(row[i] for i in s) for row in data}) if s else min(len(data), 1)

    sets = [s for k in range(len(names) + 1) for s in combinations(range(len(names)), k)]
    keys = [s for s in sets if classes(s) == len(data)]
    deps = [(s, a) for s in sets for a in range(len(names)) if a not in s and classes(s) == classes((*s, a))]
    out = [("key", ",".join(names[i] for i in s), None) for s in keys if not any(set(t) < set(s) for t in keys)]
    out += [
        ("dependency", ",".join(names[i] for i in s), names[a]) for s, a in deps if not any(b == a and set(t) < set(s) for t, b in deps)
    ]
    return sorted(out, key=str)


def got(spark, data, names, **more):
    schema = ", ".join(f"`{n}` string" for n in names)
    return sorted((tuple(r) for r in keys_and_dependencies(spark.createDataFrame(data, schema), **more).collect()), key=str)


@pytest.mark.parametrize("seed, rows, width, values", [(1, 30, 4, 4), (2, 60, 5, 3), (3, 8, 5, 2), (4, 40, 3, 40)])
def test_matches_all_column_sets(spark, seed, rows, width, values):
    r = random.Random(seed)
    data = []
    for _ in range(rows):
        row = [r.choice([None, *map(str, range(values))]) for _ in range(width)]
        row[-1] = str((row[0] or "") < (row[1] or ""))  # the first two determine the last
        data.append(tuple(row))
    names = [f"col {i}" if i == 1 else f"c{i}" for i in range(width)]
    assert got(spark, data, names) == brute(data, names)


def test_repeated_rows_constants_and_small_tables(spark):
    names = ["a", "b"]
    assert got(spark, [("1", "x"), ("1", "x"), ("2", "x")], names) == [("dependency", "", "b")]
    assert got(spark, [("1", "x")], names) == [("dependency", "", "a"), ("dependency", "", "b"), ("key", "", None)]
    assert got(spark, [], names) == got(spark, [("1", "x")], names)
    assert got(spark, [(None, "x"), (None, "y")], names) == brute([(None, "x"), (None, "y")], names)


def test_bounded_left_side_and_passes(spark, monkeypatch):
    """Fewer sets per pass and a bound on the left give the same minimal rows, up to that size."""
    monkeypatch.setattr(keys_module, "SETS_PER_PASS", 2)
    r = random.Random(9)
    data = [tuple(str(r.randint(0, 3)) for _ in range(4)) for _ in range(25)]
    data = list(dict.fromkeys(data))
    names = list("abcd")
    everything = brute(data, names)
    assert got(spark, data, names) == everything
    assert got(spark, data, names, largest=2) == [x for x in everything if x[1].count(",") < 2]


def test_hot_value(spark):
    """A value with a third of all rows is counted in the map tasks."""
    df = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 0, id) as hot", "id % 7 as code", "(id % 7) % 2 as half")
    found = {(r.kind, r.columns, r.determines) for r in keys_and_dependencies(df).collect()}
    assert ("key", "id", None) in found and ("dependency", "code", "half") in found and ("key", "hot", None) not in found


@pytest.mark.parametrize("repeats", [1, 3])
def test_tasks_hold_a_bounded_number_of_classes(spark, monkeypatch, repeats):
    """Partitions and sets per pass follow the rows, so that rows times sets of a task stay bounded."""
    monkeypatch.setattr(keys_module, "CLASSES_PER_TASK", 1000)
    errors, seen = keys_module._errors, []

    def spy(counted, sets, per_pass):
        most = counted.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
        seen.append(most * per_pass)
        return errors(counted, sets, per_pass)

    monkeypatch.setattr(keys_module, "_errors", spy)
    r = random.Random(5)
    data = [(str(i), str(r.randint(0, 99)), str(i % 7), str(i % 7 % 2)) for i in range(5000)] * repeats
    found = got(spark, data, list("abcd"))
    assert found == brute(data, list("abcd"))
    assert max(seen) < 1500  # hashing deals rows only about evenly
