"""Phrase collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import messy  # noqa: F401

from legation.llm import collocations as col
from legation.llm.collocations import Filter, build_filter, collocations, filter_bits, frequent_phrases

SCHEMA = "doc_id long, lang string, text string"


def brute_counts(rows, longest=5):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least, top=2000):
    f, n = brute_counts(rows)
    frequent = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside, out = set(), []
    for (lang, q), b in frequent.items():
        for k in range(2, len(q)):
            parts = {(lang, q[i : i + k]) for i in range(len(q) - k + 1)}
            inside |= {part for part in parts if 100 * b >= 100 * frequent[part]}
    for (lang, phrase), a in frequent.items():
        if (lang, phrase) not in inside:
            cuts = []
            for k in range(1, len(phrase)):
                left, right = f[lang, phrase[:k]], f[lang, phrase[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(phrase), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def random_rows(seed, docs, vocabulary=12):
    r = random.Random(seed)
    words = ["the", "of", "The", "in", "a", "é", "ßü", "new", "york", "city", "x1", "--"][:vocabulary]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(["new york city ", "of the  in a", r.choice(words), r.choice(words)]) + r.choice([" ", " ", "\t", ". ", ",", "\n", "\x0b"])
        rows.append((i, r.choice(["en", "de", None]), text))
    return rows


def got(spark, rows, **more):
    return sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA), **more).collect())


@pytest.mark.parametrize("seed, least, sample, lowered", [(1, 20, 3, 0.5), (2, 9, 10, 0.5), (3, 5, 4, 30.0), (4, 40, 1, 1.0)])
def test_matches_plain_counting(spark, seed, least, sample, lowered):
    """Whatever the sample proposes: everything, little, or (lowered 30) nothing at all."""
    rows = random_rows(seed, 120)
    assert got(spark, rows, least=least, sample=sample, lowered=lowered) == brute(rows, least)


def test_border_failures_are_followed_up(spark):
    """A long phrase outside the sample: each pass lengthens what is known, until closed."""
    rows = random_rows(5, 60)
    f, n = brute_counts(rows)
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "lang", "text").na.fill("und", ["lang"]).toDF("id", "lang", "text")
    for sample in (2, 1_000_000):
        found = {(r.lang, r.phrase): r.n for r in frequent_phrases(docs, 6, sample=sample).collect()}
        want = {(lang, " ".join(p)): a for (lang, p), a in f.items() if a >= 6} | {(lang, ""): c for lang, c in n.items() if c}
        assert found == want


def test_no_phrase_is_counted_twice(spark):
    docs = spark.createDataFrame(random_rows(6, 80), SCHEMA).na.fill("und", ["lang"]).toDF("id", "lang", "text")
    found = frequent_phrases(docs, 4, sample=7, lowered=2.0)
    assert found.count() == found.select("lang", "phrase").distinct().count()


@pytest.mark.parametrize("bits", [64, 256, 1024])
def test_full_filter_costs_work_not_results(spark, monkeypatch, bits):
    """A filter far too small answers yes wrongly, sometimes or nearly always; counts stay exact."""
    monkeypatch.setattr(col, "FILTER_BITS", (bits, bits))
    rows = random_rows(8, 100)
    assert got(spark, rows, least=8, sample=5, lowered=2.0) == brute(rows, 8)


def test_exact_arithmetic(spark):
    """Products beyond 64 bits do not round or fail."""
    rows = [(i, "en", "aa bb cc dd " * 3_000) for i in range(8)]
    assert got(spark, rows, least=100) == brute(rows, 100)


def test_top_and_ties(spark):
    rows = [(i, "en", f"p{j:03d} q{j:03d}") for i in range(3) for j in range(300)]
    want = brute(rows, 3, top=50)
    assert got(spark, rows, least=3, top=50) == want and len(want) == 50


def test_messy_rows(spark, messy):  # noqa: F811
    docs = messy.selectExpr("doc_id", "source as lang", "text", "keep_id", "score", "1 as n", "'x' as phrase", "2 as id")
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in collocations(docs, least=2).collect()) == brute(rows, 2)
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs.filter("text is null or trim(text) = ''"), least=1).collect() == []


def test_filter(spark):
    phrases = [("en", w) for w in ("a", "a b", "a b c", "é ☃")]
    made = build_filter(spark.createDataFrame(phrases, "lang string, phrase string"), 1 << 12)
    a, b, c = col.word_hashes(np.array(["a", "b", "c"], object), np.array(["en"] * 3, object))
    ab = col.longer(np.array([a]), np.array([b]))
    inside = np.concatenate([[a], ab, col.longer(ab, np.array([c]))])
    assert made.holds(inside).all() and isinstance(made, Filter)
    outside = col.word_hashes(np.array([f"w{i}" for i in range(500)], object), np.array(["en"] * 500, object))
    assert made.holds(outside).mean() < 0.05
    assert filter_bits(0) == col.FILTER_BITS[0] and filter_bits(10**12) == col.FILTER_BITS[1]
