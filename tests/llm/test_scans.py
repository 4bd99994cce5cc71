"""Token counts, licence scans, secret scans and benchmark matches against plain Python."""

from __future__ import annotations

import hashlib
import os
import random
import re

import pytest
from llm_helpers import messy, prose, words  # noqa: F401
from pyspark.sql import functions as F

from legation.llm import decontam
from legation.llm.decontam import Matcher, ancestors, benchmark_matches, drop_contaminated, folded, masks, myers, pieces
from legation.llm.licenses import BASE_PHRASES, NOTICE_PHRASES, Scanner, evaluate, license_scan
from legation.llm.secrets import secret_scan
from legation.llm.tokens import UnigramCounter, load_vocabulary, token_counts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


# -- token counts


def reference_tokenizer(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    low = min(score for _, score in vocabulary)
    full = [("<unk>", 0.0), *vocabulary, *((f"<0x{b:02X}>", low) for b in range(256))]
    out = tokenizers.Tokenizer(tokenizers.models.Unigram(full, unk_id=0, byte_fallback=True))
    out.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(out.encode(text, add_special_tokens=False).ids)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
def test_counts_equal_the_tokenizer():
    vocabulary = load_vocabulary(VOCABULARY)
    count, mine = reference_tokenizer(vocabulary), UnigramCounter(vocabulary, memory=50)
    texts = ["", " ", "  a  b ", "▁x", "日本語 ☃☃ text", "\n\n a\tb", "a" * 3000, *(prose(i, 60) for i in range(40))]
    assert [mine.count(t)[0] for t in texts] == [count(t) for t in texts]


def test_ties_keep_the_longest_last_piece():
    small = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), ("bb", -2.0)]
    count, mine = reference_tokenizer(small), UnigramCounter(small)
    r = random.Random(2)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(0, 12))) for _ in range(300)]
    assert [mine.count(t)[0] for t in texts] == [count(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_long_chunks_against_all_prefix_scores(seed):
    r = random.Random(seed)
    small = [(p, -float(r.randint(1, 6))) for p in ("▁", "a", "b", "c", "ab", "abc", "bca", "cccc", "▁a", "abcab")]
    pieces_, low = dict(small), min(s for _, s in small) - 10.0
    for text in ["▁" + "".join(r.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 5, 40, 700)]:
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            ways = [(best[i][0] + pieces_[text[i:end]], best[i][1] + 1) for i in range(max(0, end - 5), end) if text[i:end] in pieces_]
            if text[end - 1] not in pieces_:
                ways.append((best[end - 1][0] + low, best[end - 1][1] + 1))
            best.append(max(ways, key=lambda w: w[0]))  # the first of equals: the earliest start
        tokens, _, score = UnigramCounter(small).chunk(text)
        assert (tokens, score) == (best[-1][1], best[-1][0])


def test_token_rows(spark, messy):
    vocabulary = [("▁", -1.0), ("same", -2.0), ("text", -2.0), ("here", -2.0)]
    out = token_counts(messy, vocabulary)
    assert out.columns == ["doc_id", "n_tokens", "n_byte_tokens", "score"]
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == messy.count() and got[4].n_tokens == got[5].n_tokens == 0
    assert got[1].n_tokens == 7 and got[1].n_byte_tokens == 0  # four marks, three words
    assert got[10].n_byte_tokens > 0
    assert token_counts(messy, []).count() == messy.count()
    assert token_counts(messy.limit(0), vocabulary).collect() == []


# -- licence scans


def brute_places(text):
    w, places = words(text), []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(places)


def test_base_scan_against_brute_force():
    scanner, r = Scanner(BASE_PHRASES, NOTICE_PHRASES), random.Random(1)
    parts = ["Under the", "MIT license", "under the MIT License", "CC-BY", "nc", "Apache License, Version 2.0", "é", "cc by nc", "x1"]
    for _ in range(300):
        text = r.choice([" ", "\n", ", "]).join(r.choice(parts) for _ in range(r.randint(0, 9)))
        n, places = brute_places(text)
        got = scanner.scan(text)
        at = [i for i, _ in places]
        assert got[:5] == (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_expressions():
    assert evaluate("MIT") == (1.0, {"mit"})
    assert evaluate("MIT OR GPL-3.0-only AND CC-BY-NC-4.0") == (1.0, {"mit", "gpl-3", "cc-by-nc"})
    assert evaluate("(MIT OR GPL-3.0-only) AND CC-BY-NC-4.0")[0] == 0.2
    assert evaluate("GPL-2.0-only WITH Classpath-exception-2.0 OR AGPL-3.0")[0] == 0.5
    assert evaluate("MIT */") == (1.0, {"mit"})
    for wrong in ("", "AND", "MIT OR", "(MIT", "MIT)", "OR MIT", "()"):
        assert evaluate(wrong) is None
    scanned = Scanner(BASE_PHRASES, NOTICE_PHRASES).scan("# SPDX-License-Identifier: MIT OR Apache-2.0\nUnder the MIT license.")
    assert scanned[4:8] == ("mit", "apache-2,mit", 1.0, 1)


def test_many_places_and_licences_in_one_text():
    scanner = Scanner(BASE_PHRASES, NOTICE_PHRASES)
    got = scanner.scan("a under the mit license apache license version 2 cc by nc " * 20_000)
    assert got[:4] == (12 * 20_000, 60_000, 1, 12 * 20_000 - 3)
    chain = " OR ".join(f"(Licence-{i} AND MIT)" for i in range(20_000))
    free, labels = evaluate(chain)
    assert free == 0.4 and len(labels) == 20_001
    assert evaluate("A-1 OR (B-1 AND (C-1 OR D-1))")[1] == {"a-1", "b-1", "c-1", "d-1"}


def test_license_rows(spark, messy):
    out = license_scan(messy)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == messy.count() and license_scan(messy.limit(0)).collect() == []
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert got[8].n_words == 20_000 and got[10].n_words == 4


# -- secret scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_base_spans_against_brute_force(spark):
    r = random.Random(4)
    parts = ["password", "ToKeN", "=", ":", " ", '"', "secret=token", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "☃é", "api_key", "x"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    text = dict(docs)
    for row in secret_scan(df, F.lit("o"), F.lit("r")).collect():
        want = brute_spans(text[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text[row.doc_id]
        assert set(filter(None, want.split(","))) <= set(row.spans.split(","))


def test_ownership(spark, messy):
    docs = [(i, f"token = copied{i % 1}Value987", f"owner{i % 4}") for i in range(40)]
    docs += [(100, "token = ownerSpecific42x", "owner0"), (101, "token = ownerSpecific42x", "owner0"), (102, "token = aaaaaaaaaa", "owner1")]
    docs += [(103, "token = two0wnersKey", "owner1"), (104, "token = two0wnersKey", "owner2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_shared, r.n_example, r.max_owners) for r in secret_scan(df, F.col("source"), F.col("source")).collect()}
    assert got[0] == (0, 0, 1, 4) and got[100] == (1, 0, 0, 1) and got[102] == (0, 0, 1, 1) and got[103] == (0, 1, 0, 2)
    out = secret_scan(messy, F.col("source"), F.col("source"))
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == messy.count() and rows[10].n_assign == 1 and rows[10].spans == "assign:6:23"
    assert rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan(messy.limit(0), F.col("source"), F.col("source")).collect() == []


# -- benchmark matches


def edit_distance_ends(pattern, text):
    row = list(range(len(pattern) + 1))
    ends = []
    for char in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != char), row[i + 1] + 1, new[i] + 1))
        row = new
        ends.append(row[-1])
    return ends


def test_myers_is_the_edit_distance():
    r = random.Random(6)
    for _ in range(200):
        pattern = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        assert myers(masks(pattern), len(pattern), text) == edit_distance_ends(pattern, text)
    assert pieces(10, 3) == [(0, 2), (2, 5), (5, 7), (7, 10)]


def test_ancestors():
    """Every leaf's runs grow by neighbours up to the whole, and runs of one level tile the leaves."""
    for n in range(1, 60):
        chains = ancestors(n)
        for leaf, runs in enumerate(chains):
            sizes = [(leaf, leaf + 1), *runs]
            assert all(a <= b < c <= d and (b, c) != (a, d) for (b, c), (a, d) in zip(sizes, sizes[1:]))
        first = sorted({runs[0] for runs in chains if runs})
        assert not first or [x for run in first for x in range(*run)] == list(range(n))


@pytest.mark.parametrize("rate", [0.08, 0.14, 0.3])
def test_matches_against_brute_force(rate):
    r = random.Random(9)
    items = [(i, folded(prose(100 + i, 12))) for i in range(12)] + [(50, "short"), (51, "")]
    matcher = Matcher(items, rate)
    for n in range(150):
        text = list(prose(1000 + n, 30))
        for _ in range(r.randint(0, 2)):
            item = list(r.choice(items)[1])
            for _ in range(r.randint(0, 9 if rate < 0.1 else 30)):
                if item:
                    at = r.randrange(len(item))
                    item[at : at + r.randint(0, 1)] = r.choice(["", "x", "yz"])
            at = r.randrange(len(text))
            text[at:at] = item
        text = folded("".join(text))
        want = {}
        for item_id, item in items:
            best = min(edit_distance_ends(item, text), default=99) if item else 99
            if item and best <= int(len(item) * rate):
                want[item_id] = best
        got = matcher.matches(text)
        assert {m[0]: m[1] for m in got} == want
        for item_id, distance, start, end, _ in got:
            item = dict(items)[item_id]
            assert edit_distance_ends(item + "\0" * 0, text[start:end])[-1] == distance


def test_runs_are_tested_once_per_start(monkeypatch):
    """All pieces of an occurrence name one start: its runs are not tested again for each of them."""
    calls, occurs = [], decontam.occurs
    monkeypatch.setattr(decontam, "occurs", lambda *a: calls.append(a) or occurs(*a))
    item = folded(prose(7, 40))
    leaves = int(len(item) * 0.14) + 1
    assert Matcher([(1, item)], 0.14).matches(f"so {item} on") == [(1, 0, 3, 3 + len(item), 1)]
    assert 0 < len(calls) < leaves


def test_occurs_gives_up_only_when_certain():
    r = random.Random(11)
    for _ in range(1500):
        pattern = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        text, budget = "".join(r.choice("abc") for _ in range(r.randint(0, 20))), r.randint(0, 5)
        best = min([len(pattern), *edit_distance_ends(pattern, text)])
        assert decontam.occurs(masks(pattern), len(pattern), text, budget) == (best <= budget)


def test_match_rows_and_blocks(spark, messy):
    items = spark.createDataFrame(
        [(1, "SAME text  here"), (2, None), (3, " "), (4, prose(1, 20_000)[50:300]), (None, "same text here"), (5, "same text here")],
        "item_id long, text string",
    )
    whole = benchmark_matches(messy, items)
    # The item without an id is matched too, and reported as null.
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in whole.collect())
    assert got == sorted([(d, i, 0) for d in (0, 1, 2, 3) for i in (0, 1, 5)] + [(d, 4, 0) for d in (8, 9, 9)])
    blocks = benchmark_matches(messy, items, block_chars=1)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))
    kept = drop_contaminated(messy, items)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 10, 11}
    assert [r.text for r in kept.collect() if r.doc_id is None] == [None]  # the other one holds an item
    assert benchmark_matches(messy.limit(0), items).collect() == [] == benchmark_matches(messy, items.limit(0)).collect()
