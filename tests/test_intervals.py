"""As-of joins, spells and numbers in post against plain Python, with hot groups, ties, nulls and borders."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from legation.operators import in_post, join_as_of, tenure_spells, validity
from legation.operators.intervals import _slices

VERSIONS = "code string, begin int, until int, name string"
FACTS = "id int, state string, day int"
POSTINGS = "state string, begin int, until int"


@pytest.fixture
def narrow(spark):
    """Many slices, so that groups cross borders."""
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_state(r):
    return r.choice(["hot", "hot", r.choice("abcdef"), None])


def as_of(facts, versions, ends=True):
    out = []
    for i, state, day in facts:
        known = [
            (begin, name, until)
            for code, begin, until, name in versions
            if code is not None and code == state and begin is not None and day is not None and begin <= day
        ]
        best = max(known, key=lambda v: (v[0], (v[1] is not None, v[1] or ""), (v[2] is not None, v[2] or 0)), default=None)
        if best and ends and best[2] is not None and best[2] <= day:
            best = None
        out.append((i, state, day, best[1] if best else None))
    return sorted(out, key=lambda x: tuple((v is not None, v) for v in x))


def found(spark, facts, versions, end="until"):
    f, v = spark.createDataFrame(facts, FACTS), spark.createDataFrame(versions, VERSIONS)
    return rows(join_as_of(f, v, "state", "code", "day", "begin", end, ["name"]))


def test_as_of_matches_plain_search(spark, narrow):
    r = random.Random(4)
    facts = [(i, hot_state(r), r.choice([None, *range(120)])) for i in range(1500)]
    versions = [(hot_state(r), b := r.randint(0, 100), r.choice([None, b, b + 3, b + 30]), r.choice(["x", "y", "z", None])) for _ in range(200)]
    assert found(spark, facts, versions) == as_of(facts, versions)
    assert found(spark, facts, versions, None) == as_of(facts, versions, ends=False)


def test_both_ends_and_gaps(spark):
    versions = [("a", 10, 20, "first"), ("a", 30, None, "second")]
    facts = [(i, "a", i) for i in (9, 10, 19, 20, 29, 30, 99)]
    names = {r[0]: r[3] for r in found(spark, facts, versions)}
    assert names == {9: None, 10: "first", 19: "first", 20: None, 29: None, 30: "second", 99: "second"}


def test_a_version_far_back_reaches_later_slices(spark, narrow):
    """One version, and a third of all facts on one day of one state."""
    facts = [(i, "a", 500 if i % 3 == 0 else i) for i in range(3000)]
    got = found(spark, facts, [("a", 0, None, "old"), ("b", 1, None, "other")])
    assert len(got) == 3000 and {r[3] for r in got} == {"old"}


def test_facts_keep_all_columns_and_copies(spark):
    f = spark.createDataFrame([(1, "a", 5, "x"), (1, "a", 5, "x"), (2, None, 5, "y"), (3, "a", None, "z")], FACTS + ", begin string")
    v = spark.createDataFrame([("a", 1, None, "n"), (None, 1, None, "never")], VERSIONS)
    out = join_as_of(f, v, "state", "code", "day", "begin", "until", ["name", "until"])
    assert out.columns == ["id", "state", "day", "begin", "name", "until"]
    assert rows(out.select("id", "begin", "name")) == [(1, "x", "n"), (1, "x", "n"), (2, "y", None), (3, "z", None)]
    assert rows(join_as_of(f.limit(0), v, "state", "code", "day", "begin")) == []
    assert {r[-1] for r in rows(join_as_of(f, v.limit(0), "state", "code", "day", "begin", "until", ["name"]))} == {None}


def test_several_key_columns(spark):
    f = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 2, 5)], "id int, k string, j int, day int")
    v = spark.createDataFrame([("a", 1, 0, "one"), ("a", 2, 6, "two")], "k string, j int, begin int, name string")
    assert rows(join_as_of(f, v, ["k", "j"], ["k", "j"], "day", "begin", columns=["name"])) == [(1, "a", 1, 5, "one"), (2, "a", 2, 5, None)]


def test_validity(spark, narrow):
    r = random.Random(5)
    dated = [(hot_state(r), r.choice([None, *range(60)]), i) for i in range(300)]
    want, by_key = [], defaultdict(list)
    for code, begin, i in dated:
        if begin is not None:
            by_key[code].append((begin, i))
    for code, versions in by_key.items():
        versions.sort()
        want += [(code, b, i, n[0]) for (b, i), n in zip(versions, [*versions[1:], (None, None)])]
    got = rows(validity(spark.createDataFrame(dated, "code string, begin int, id int"), "code", "begin"))
    assert got == sorted(want, key=lambda x: tuple((v is not None, v) for v in x))


def spells(postings):
    out, by_state = [], defaultdict(list)
    for state, b, e in postings:
        if b is not None and (e is None or e >= b):
            by_state[state].append((b, float("inf") if e is None else e))
    for state, all_ in by_state.items():
        merged = []
        for b, e in sorted(all_):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([b, e, 1])
        out += [(state, b, None if e == float("inf") else e, n) for b, e, n in merged]
    return sorted(out, key=lambda x: tuple((v is not None, v) for v in x))


def random_postings(seed, n, span):
    r = random.Random(seed)
    return [(hot_state(r), b := r.choice([None, *range(span)]), None if b is None or r.random() < 0.002 else b + r.randint(-1, 6)) for _ in range(n)]


@pytest.mark.parametrize("seed, n, span", [(1, 400, 3000), (2, 1500, 2000), (3, 60, 50)])
def test_spells_match_plain_merge(spark, narrow, seed, n, span):
    postings = random_postings(seed, n, span)
    assert rows(tenure_spells(spark.createDataFrame(postings, POSTINGS), "state", "begin", "until")) == spells(postings)


def test_spells_touch_and_open(spark):
    postings = [("a", 1, 3), ("a", 3, 4), ("a", 5, 6), ("a", 8, None), ("a", 99, 100), ("b", 2, 2), ("b", 2, 2), ("c", 5, 1)]
    assert rows(tenure_spells(spark.createDataFrame(postings, POSTINGS), "state", "begin", "until")) == [
        ("a", 1, 4, 2), ("a", 5, 6, 1), ("a", 8, None, 2), ("b", 2, 2, 2),
    ]


def test_one_spell_over_many_slices(spark, narrow):
    """A long posting at the start joins everything that follows, however many slices away."""
    postings = [("a", 0, 10_000)] + [("a", 3 * i, 3 * i + 1) for i in range(1, 2000)] + [("a", 20_000, 20_001)]
    got = rows(tenure_spells(spark.createDataFrame(postings, POSTINGS), "state", "begin", "until"))
    assert got == [("a", 0, 10_000, 2000), ("a", 20_000, 20_001, 1)]


def test_hot_group_spans_many_slices(spark, narrow):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"), F.col("id").alias("at"))
    sizes = _slices(df, ["g"], [F.col("at").asc()]).where("g = 0").groupBy("__slice").count().collect()
    assert len(sizes) > 5 and sum(r["count"] for r in sizes) == 10_000


def numbers(postings):
    out, by_state = [], defaultdict(list)
    for state, b, e in postings:
        if b is not None and (e is None or e >= b):
            by_state[state].append((b, e))
    for state, all_ in by_state.items():
        for day in {d for p in all_ for d in p if d is not None}:
            out.append((
                state, day, sum(b == day for b, _ in all_), sum(e == day for _, e in all_),
                sum(b <= day and (e is None or e > day) for b, e in all_),
            ))
    return sorted(out, key=lambda x: tuple((v is not None, v) for v in x))


@pytest.mark.parametrize("seed, n, span", [(6, 500, 2000), (7, 800, 60)])
def test_in_post_matches_plain_count(spark, narrow, seed, n, span):
    postings = random_postings(seed, n, span)
    assert rows(in_post(spark.createDataFrame(postings, POSTINGS), "state", "begin", "until")) == numbers(postings)


def test_empty_tables(spark):
    none = spark.createDataFrame([], POSTINGS)
    assert rows(tenure_spells(none, "state", "begin", "until")) == rows(in_post(none, "state", "begin", "until")) == []
    assert rows(validity(none, "state", "begin", "next")) == []
