"""Operators against brute-force Python on random small inputs."""

from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from legation.operators import (
    bilateral_matrix,
    change_over,
    complete,
    crosstab,
    diff_versions,
    distinct_partners,
    latest_per_key,
    marginals,
    merge_versions,
    parity_ratio,
    profile,
    rank_within,
    rollup_counts,
    share_by,
    share_of_total,
    top_n_per_group,
    unmatched_codes,
    whole_row_changes,
)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

senders = st.sampled_from(["AAA", "BBB", "CCC", None])
categories = st.sampled_from(["W", "M", "O", None])
facts_st = st.lists(st.tuples(senders, categories, st.sampled_from(["head", "deputy"])), max_size=40)
FACT_SCHEMA = "sender string, category string, posting string"


def _ratio(a, b):
    return None if b == 0 else a / b


@SETTINGS
@given(facts=facts_st)
def test_share_and_parity(spark, facts):
    df = spark.createDataFrame(facts, FACT_SCHEMA)
    total, hit, men = Counter(), Counter(), Counter()
    for s, c, _ in facts:
        total[s] += c is not None
        hit[s] += c == "W"
        men[s] += c == "M"
    groups = {s for s, _, _ in facts}
    want = {s: (total[s], hit[s], _ratio(hit[s], total[s])) for s in groups}
    got = {r[0]: tuple(r[1:]) for r in share_by(df, "sender", "category", "W").collect()}
    assert got == want
    want = {s: (hit[s], men[s], _ratio(hit[s], men[s])) for s in groups}
    got = {r[0]: tuple(r[1:]) for r in parity_ratio(df, "sender", "category", "W", "M").collect()}
    assert got == want


@SETTINGS
@given(facts=facts_st)
def test_rollup_and_crosstab(spark, facts):
    df = spark.createDataFrame(facts, FACT_SCHEMA)
    got = {(r[0], r[1], r[3], r[4]): r[2] for r in rollup_counts(df, ["posting", "sender"]).collect()}
    want: Counter = Counter()
    for s, _, p in facts:
        want[(p, s, 0, 0)] += 1
        want[(p, None, 0, 1)] += 1
        want[(None, None, 1, 1)] += 1
    # Spark gives no rows at all (not even a grand total) for empty input.
    assert got == dict(want)
    tab = {r[0]: tuple(r[1:]) for r in crosstab(df, "posting", "category", ["W", "M"]).collect()}
    cells: defaultdict = defaultdict(lambda: [0, 0])
    for _, c, p in facts:
        row = cells[p]  # every posting gets a row, even without W or M
        if c in ("W", "M"):
            row[["W", "M"].index(c)] += 1
    assert tab == {p: tuple(v) for p, v in cells.items()}


series_st = st.dictionaries(
    st.tuples(st.sampled_from(["A", "B", None]), st.integers(2000, 2006)),
    st.integers(0, 50),
    max_size=20,
)


@SETTINGS
@given(series=series_st)
def test_change_over(spark, series):
    data = [(k, p, float(v)) for (k, p), v in series.items()]
    df = spark.createDataFrame(data, "k string, period int, v double")
    got = {(r["k"], r["period"]): (r["v"], r["previous"], r["change"]) for r in change_over(df, "period", "v", "k").collect()}
    want = {}
    for (k, p), v in series.items():
        prev = series.get((k, p - 1))
        want[(k, p)] = (float(v), None if prev is None else float(prev), None if prev is None else float(v - prev))
    assert got == want


scores_st = st.lists(
    st.tuples(st.sampled_from(["E", "F", None]), st.text("abcdef", min_size=1, max_size=3), st.integers(0, 4)),
    max_size=25,
    unique_by=lambda t: (t[0], t[1]),
)


@SETTINGS
@given(scores=scores_st, n=st.integers(1, 3))
def test_rank_and_top_n(spark, scores, n):
    df = spark.createDataFrame(scores, "g string, name string, v int")
    got = {(r["g"], r["name"]): r["rank"] for r in rank_within(df, "g", "v").collect()}
    want = {}
    for g, name, v in scores:
        higher = {w for h, _, w in scores if h == g and w > v}
        want[(g, name)] = len(higher) + 1
    assert got == want
    split = {(r["g"], r["name"]): r["rank"] for r in rank_within(df, "g", "v", large_groups=True).collect()}
    assert split == want
    got_top = {(r["g"], r["name"]) for r in top_n_per_group(df, "g", "v", n, tie_break="name").collect()}
    want_top = set()
    for g in {s[0] for s in scores}:
        members = sorted((s for s in scores if s[0] == g), key=lambda s: (-s[2], s[1]))
        want_top |= {(s[0], s[1]) for s in members[:n]}
    assert got_top == want_top


versions_st = st.dictionaries(st.sampled_from("abcdefg"), st.sampled_from(["x", "y", None]), max_size=6)


@SETTINGS
@given(old=versions_st, new=versions_st)
def test_merge_and_diff(spark, old, new):
    schema = "k string, v string"
    o = spark.createDataFrame(list(old.items()), schema)
    n = spark.createDataFrame(list(new.items()), schema)
    assert dict((r[0], r[1]) for r in merge_versions(o, n, "k").collect()) == {**old, **new}
    got = {r["k"]: r["change"] for r in diff_versions(o, n, "k").collect()}
    want = {}
    for k in set(old) | set(new):
        if k not in old:
            want[k] = "added"
        elif k not in new:
            want[k] = "removed"
        elif old[k] != new[k]:
            want[k] = "changed"
    assert got == want


@SETTINGS
@given(
    counts=st.dictionaries(st.tuples(st.sampled_from("pqr"), st.integers(1, 4)), st.integers(1, 9), max_size=8),
    names=st.sets(st.sampled_from("pqrs"), min_size=1),
)
def test_complete(spark, counts, names):
    c = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "name string, period int, n bigint")
    dom = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r[0], r[1]): r[2] for r in complete(c, {"name": dom, "period": [1, 2, 3]}, ["n"]).collect()}
    # The whole grid, and every count outside it: totals reconcile.
    want = {(a, b): 0 for a in names for b in (1, 2, 3)} | dict(counts)
    assert got == want


rows_st = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([1, 2, None])), max_size=12)


@SETTINGS
@given(old=rows_st, new=rows_st)
def test_whole_row_changes_is_multiset_difference(spark, old, new):
    schema = "k string, v int"
    got = {
        (r["k"], r["v"], r["side"]): r["n"]
        for r in whole_row_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    }
    a, b = Counter(old), Counter(new)
    want = {(*row, "old"): n for row, n in (a - b).items()}
    want.update({(*row, "new"): n for row, n in (b - a).items()})
    assert got == want


@SETTINGS
@given(
    counts=st.lists(st.tuples(st.sampled_from(["E", "F", None]), st.integers(0, 9)), max_size=10)
)
def test_share_of_total(spark, counts):
    data = [(p, f"m{i}", n) for i, (p, n) in enumerate(counts)]
    df = spark.createDataFrame(data, "p string, m string, n bigint")
    parent_total: Counter = Counter()
    for p, _, n in data:
        parent_total[p] += n
    got = {r["m"]: r["share"] for r in share_of_total(df, "n", parent="p").collect()}
    assert got == {m: _ratio(n, parent_total[p]) for p, m, n in data}
    total = sum(n for _, _, n in data)
    got = {r["m"]: r["share"] for r in share_of_total(df, "n").collect()}
    assert got == {m: _ratio(n, total) for _, m, n in data}


@SETTINGS
@given(
    facts=st.lists(st.sampled_from(["A", "B", "C", None]), max_size=15),
    dim=st.sets(st.sampled_from(["A", "B", "D"])),
)
def test_unmatched_codes(spark, facts, dim):
    f = spark.createDataFrame([(x,) for x in facts], "code string")
    d = spark.createDataFrame([(x,) for x in dim], "key string")
    got = {r["code"]: r["n"] for r in unmatched_codes(f, d, "code", "key").collect()}
    want = {c: n for c, n in Counter(facts).items() if c is None or c not in dim}
    assert got == want


pairs_st = st.lists(st.tuples(st.sampled_from(["A", "B", None]), st.sampled_from(["x", "y", "z", None])), max_size=20)


@SETTINGS
@given(pairs=pairs_st)
def test_distinct_partners(spark, pairs):
    df = spark.createDataFrame(pairs, "k string, p string")
    want = {k: len({p for kk, p in pairs if kk == k and p is not None}) for k, _ in pairs}
    got = {r["k"]: r["n_partners"] for r in distinct_partners(df, "k", "p").collect()}
    assert got == want
    approx = {r["k"]: r["n_partners"] for r in distinct_partners(df, "k", "p", approx=True).collect()}
    assert approx == want  # exact at this size


@SETTINGS
@given(values=st.lists(st.sampled_from(["AB", "ab", "ABC", None]), max_size=20))
def test_profile_counts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = {r["column_name"]: tuple(r)[1:] for r in profile(df, key="c", patterns={"c": "^[A-Z]+$"}).collect()}
    present = [v for v in values if v is not None]
    misses = sum(1 for v in present if not v.isupper())
    assert got["c"] == (len(values), len(values) - len(present), len(set(present)), misses)
    assert got["key(c)"] == (len(values), None, len(set(present)), None)


@SETTINGS
@given(
    rows_=st.lists(
        st.tuples(st.sampled_from("kl"), st.sampled_from([1, 2, None]), st.sampled_from(["x", "y", None])),
        max_size=12,
    )
)
def test_latest_per_key(spark, rows_):
    df = spark.createDataFrame(rows_, "k string, ver int, p string")
    got = {r["k"]: r["p"] for r in latest_per_key(df, "k", "ver").collect()}

    def order(r):  # nulls order first, then by version, then by payload
        return tuple((v is not None, v if v is not None else 0) for v in (r[1], r[2]))

    want = {}
    for k in {r[0] for r in rows_}:
        want[k] = max((r for r in rows_ if r[0] == k), key=order)[2]
    assert got == want


@SETTINGS
@given(facts=facts_st)
def test_marginals(spark, facts):
    df = spark.createDataFrame(facts, FACT_SCHEMA)
    got = {(r["sender"], r["category"], r["posting"], r["g_sender"], r["g_category"], r["g_posting"]): r["n"]
           for r in marginals(df, [["sender", "category"], ["posting"]]).collect()}
    want: Counter = Counter()
    for s_, c, p in facts:
        want[(s_, c, None, 0, 0, 1)] += 1
        want[(None, None, p, 1, 1, 0)] += 1
    assert got == dict(want)


@SETTINGS
@given(
    pairs=st.lists(st.tuples(st.sampled_from(["A", "B", "X"]), st.sampled_from(["A", "B", "C"])), max_size=20)
)
def test_bilateral_matrix(spark, pairs):
    facts = spark.createDataFrame(pairs, "s string, r string")
    groups = {"A": "north", "B": "south", "C": "north"}  # X has no dimension row
    dim = spark.createDataFrame(list(groups.items()), "code string, grp string")
    got = {(r[0], r[1]): r[2] for r in bilateral_matrix(facts, dim, "s", "r", "code", "grp").collect()}
    want: Counter = Counter()
    for s_, r in pairs:
        want[(groups.get(s_), groups.get(r))] += 1
    assert got == dict(want)

