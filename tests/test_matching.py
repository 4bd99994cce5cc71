"""Suggested matches against the edit distance of all pairs in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from legation.operators import matching, suggested_matches


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(left, right, d):
    return {(a, b, e) for a in set(left) - {None} for b in set(right) - {None} if (e := edits(a, b)) <= d}


def got(spark, left, right, **more):
    a = spark.createDataFrame([(x,) for x in left], "name string")
    b = spark.createDataFrame([(x, 1) for x in right], "country string, distance int")
    rows = [tuple(r) for r in suggested_matches(a, b, "name", "country", **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def changed(word, r, times):
    for _ in range(times):
        at, c = r.randint(0, len(word)), r.choice("abcé ")
        word = r.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])
    return word


@pytest.mark.parametrize("d,q", [(0, 2), (1, 2), (2, 2), (2, 3), (3, 3)])
def test_equals_all_pairs(spark, d, q):
    r = random.Random(d * 10 + q)
    right = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 14))) for _ in range(60)]
    left = [changed(r.choice(right), r, r.randint(0, d + 1)) for _ in range(60)]
    assert got(spark, left, right, max_distance=d, q=q) == brute(left, right, d)


def test_short_repetitive_and_empty_names(spark):
    names = ["", "a", "b", "ab", "ba", "aa", "aaa", "aaaa", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "abababababab", "bababababab", "\x01", "xyz"]
    for d in (1, 2, 3):
        assert got(spark, names, names, max_distance=d) == brute(names, names, d)


def test_letters_beyond_ascii_and_quotes(spark):
    left = ["Côte d’Ivoire", "Turkiye", "Åland", "日本国", "𝒜b"]
    right = ["Côte d'Ivoire", "Türkiye", "Aland", "日本", "𝒜c"]
    assert got(spark, left, right) == brute(left, right, 2)


def test_nulls_repeats_and_empty_tables(spark):
    assert got(spark, ["Perù", "Perù", None], ["Peru", "Peru", None]) == {("Perù", "Peru", 1)}
    assert got(spark, [], ["Peru"]) == set() == got(spark, ["Peru"], [])


def test_nearest_with_ties(spark):
    out = got(spark, ["Irak", "Iran", "none at all"], ["Iraq", "Iran", "Irax"], nearest=True)
    assert out == {("Irak", "Iran", 1), ("Iran", "Iran", 0)}


def test_hot_gram(spark):
    """A third of all names share every gram but a few: no link is lost, and none is met twice."""
    right = [f"Republic of {i:03d}" for i in range(100)] + [f"{i * 7919:x} land {i}" for i in range(200)]
    left = [changed(x, random.Random(x), 1) for x in right[::3]]
    assert got(spark, left, right, max_distance=1) == brute(left, right, 1)


def test_rejects_wrong_parameters(spark):
    df = spark.createDataFrame([("a",)], "name string")
    for more in ({"max_distance": -1}, {"q": 1}):
        with pytest.raises(ValueError):
            suggested_matches(df, df, "name", "name", **more)


def sides(spark, left, right):
    rows = [(x, x in left, x in right) for x in {*left, *right}]
    return spark.createDataFrame(rows, "name string, left boolean, right boolean")


def test_windows_and_grams_equal_all_pairs(spark):
    r = random.Random(8)
    right = ["".join(r.choice("aab ") for _ in range(r.randint(0, 12))) for _ in range(40)]
    left = [changed(r.choice(right), r, r.randint(0, 3)) for _ in range(40)]
    names, expected = sides(spark, left, right), brute(left, right, 2)
    for p, tail in ((3, False), (7, True), (20, False)):
        found = [tuple(x) for x in matching._by_windows(names, 2, p, tail).collect()]
        assert len(found) == len(expected) and set(found) == expected
    found = [tuple(x) for x in matching._by_grams(matching._keys(names, 2, 3), 2).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_names_hot_at_both_ends(spark):
    """Windows at either end are shared by all: grams or longer windows take over and lose nothing."""
    codes = [f"{i * 7919 % 100003:05d}" for i in range(120)]
    right, left = ([f"Republic of the {change(c)} united lands" for c in codes] for change in (str, lambda c: changed(c, random.Random(c), 2)))
    names = sides(spark, left, right)
    assert min(matching._window_pairs(names, 2, 10, tail) for tail in (False, True)) > 46 * names.count()
    assert got(spark, left, right) == brute(left, right, 2)


def test_pairs_follow_the_names_and_no_side_is_broadcast(spark):
    """Few words and a code: the words are frequent, and so are the code's grams as names grow in number."""
    right = [f"{'large ring hot bolt'.split()[i % 4]} {hashlib.md5(str(i).encode()).hexdigest()[:8]}" for i in range(6000)]
    left = ["#" + x[1:] for x in right]
    names = sides(spark, left, right)
    assert matching._window_pairs(names, 2, 10, True) < 46 * names.count()
    a, b = (spark.createDataFrame([(x,) for x in some], "name string") for some in (left, right))
    out = suggested_matches(a, b, "name", "name")
    assert "Broadcast" not in out._jdf.queryExecution().toString()
    assert out.where("distance = 1").count() >= 6000
