"""Maintained counts against counting each version anew."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from legation.operators import fold_batches, maintained_counts, record_changes, rollup_counts, signed_changes, whole_row_changes

SCHEMA = "id int, state string, category string"
KEYS = ["state", "category"]


def versions(k=4, n=60):
    r = random.Random(5)
    draw = lambda i: (i, r.choice(["hot", "hot", "a", None]), r.choice("WMO"))
    rows, out = [], []
    for v in range(k):
        kept = [draw(x[0]) if r.random() < 0.2 else x for x in rows if r.random() > 0.2]
        rows = kept + [draw(v * n + i) for i in range(n)]
        rows += rows[:3]  # repeated rows
        out.append(rows)
    return out


def counted(rows):
    return dict(Counter((s, c) for _, s, c in rows))


def got(spark, path, **more):
    return {(r.state, r.category): r.n for r in maintained_counts(spark, path, KEYS, **more).collect()}


def test_follows_versions_replays_and_folds(spark, workdir):
    path, data = f"{workdir}/counts", versions()
    frames = [spark.createDataFrame([], SCHEMA)] + [spark.createDataFrame(v, SCHEMA) for v in data]
    deltas = [signed_changes(whole_row_changes(a, b)) for a, b in zip(frames, frames[1:])]
    for batch in (0, 1):
        record_changes(deltas[batch], path, KEYS, batch)
        assert got(spark, path) == counted(data[batch])
    record_changes(deltas[1], path, KEYS, 1)  # replayed
    assert got(spark, path) == counted(data[1]) and got(spark, path, upto=0) == counted(data[0])
    record_changes(deltas[3], path, KEYS, 3)  # early
    record_changes(deltas[2], path, KEYS, 2)
    assert got(spark, path) == counted(data[3])
    fold_batches(spark, path, KEYS, 2)
    record_changes(deltas[0], path, KEYS, 0)  # replayed behind the base
    fold_batches(spark, path, KEYS, 2)
    assert got(spark, path) == counted(data[3]) and got(spark, path, upto=2) == counted(data[2])
    fold_batches(spark, path, KEYS, 3)
    assert got(spark, path) == counted(data[3])
    anew = rollup_counts(frames[4], KEYS).collect()
    kept = rollup_counts(maintained_counts(spark, path, KEYS), KEYS, weight="n").collect()
    assert sorted(map(str, anew)) == sorted(map(str, kept))


def test_corrected_and_empty_batches(spark, workdir):
    path = f"{workdir}/counts"
    rows = lambda *x: spark.createDataFrame(list(x), "state string, category string, n long")
    record_changes(rows(), path, KEYS, 0)
    assert got(spark, path) == {}
    record_changes(rows(("a", "W", 2), ("a", "M", None), (None, None, 1)), path, KEYS, 1)
    assert got(spark, path) == {("a", "W"): 2, (None, None): 1}
    record_changes(rows(("a", "W", -2), ("a", "O", 1)), path, KEYS, 2)
    assert got(spark, path) == {("a", "O"): 1, (None, None): 1}
    record_changes(rows(), path, KEYS, 2)  # corrected: nothing changed after all
    assert got(spark, path) == {("a", "W"): 2, (None, None): 1}
    with pytest.raises(ValueError):
        record_changes(rows(), path, KEYS, -1)
