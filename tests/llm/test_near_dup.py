from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from llm_helpers import messy, prose, words  # noqa: F401

from legation.llm.components import components
from legation.llm.near_dup import drop_near_duplicates, near_duplicates, signature, similarity, weighted_shingles
from legation.llm.words import BLOCK, word_hashes


def brute_similarity(x: dict, y: dict) -> float:
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return max(plain, total)


def weights(text: str, k: int = 5) -> dict:
    w, out = words(text), {}
    for i in range(max(1, len(w) - k + 1)) if w else ():
        s = tuple(w[i : i + k])
        out[s] = out.get(s, 0) + 1
    return {s: 1 + np.log(c) for s, c in out.items()}


def brute_classes(docs: dict, threshold: float = 0.8) -> dict:
    sets = {i: weights(t or "") for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and brute_similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_words_and_hashes():
    texts = ["Ab-c é1", "", None, "ab c É1", "a" * 50_000]
    hashes, first = word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [len(words(t or "")) for t in texts]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and hashes[2] != hashes[5]


def test_words_that_cross_blocks_and_exceed_them():
    long_word = "".join(random.Random(2).choices("abcdefghij", k=5 * BLOCK // 2))
    spread = [long_word, "x" * (BLOCK - 3), "ab", "cdefgh", "y" * BLOCK, prose(4, 60_000)]
    alone = np.concatenate([word_hashes(pa.array([w]))[0] for w in " ".join(spread).split()])
    together, first = word_hashes(pa.array(["", "- " + " ".join(spread), None, long_word[:-1] + "!", long_word]))
    assert np.array_equal(together[: len(alone)], alone) and first.tolist() == [0, 0, len(alone), len(alone), len(alone) + 1, len(alone) + 2]
    assert together[-1] == alone[0] != together[-2]


def test_hashing_holds_little_more_than_the_text():
    text = pa.array([prose(6, 100_000) * 20])
    size = len(text[0].as_py())
    tracemalloc.start()
    hashes, _ = word_hashes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) > size / 10 and peak < 16 * size + 16 * BLOCK * 8  # spans and hashes, no table as long as the text


def test_similarity_is_the_definition():
    r = random.Random(3)
    for _ in range(20):
        base = prose(r.randint(0, 99), 40).split()
        other = [w if r.random() > 0.1 else "zz" for w in base] + base[: r.randint(0, 20)]
        a, b = " ".join(base + base[:10]), " ".join(other)
        sides = []
        for t in (a, b):
            h, first = word_hashes(pa.array([t]))
            sides.append(weighted_shingles(h[first[0] : first[1]], 5))
        assert abs(similarity(*sides) - brute_similarity(weights(a), weights(b))) < 1e-9


def test_registers_agree_with_probability_jaccard():
    r = np.random.default_rng(1)
    agree, true = [], []
    for _ in range(60):
        x = np.unique(r.integers(0, 2**62, 120).astype(np.uint64))
        y = np.unique(np.concatenate([x[:100], r.integers(0, 2**62, 15).astype(np.uint64)]))
        wx, wy = 1 + (x % np.uint64(3)).astype(float), 1 + (y % np.uint64(3)).astype(float)
        agree.append((signature(x, wx, 64) == signature(y, wy, 64)).mean())
        c, i, j = np.intersect1d(x, y, return_indices=True)
        union = {**dict(zip(x.tolist(), wx)), **dict(zip(y.tolist(), wy))}
        dx, dy = dict(zip(x.tolist(), wx)), dict(zip(y.tolist(), wy))
        true.append(sum(1 / sum(max(dx.get(u, 0) / dx[e], dy.get(u, 0) / dy[e]) for u in union) for e in c.tolist()))
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def test_classes_against_brute_force(spark):
    r, docs = random.Random(5), {}
    for i in range(160):
        if i < 20 or r.random() < 0.25:
            docs[i] = prose(i, r.choice([3, 8, 60, 150]))
        else:
            w = docs[r.randrange(i)].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 9))
            docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_one_large_group(spark):
    """Copies of one text with 0 to 5 edits each: the exact residual comparison finds every class."""
    base, r, docs = prose(7, 150).split(), random.Random(8), {}
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "e" + str(r.randint(0, 10**6))
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_messy(spark, messy):
    out = near_duplicates(messy).collect()
    assert len(out) == messy.count()
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append(x)
    assert {by[i][0].class_id for i in (1, 2, 3)} == {1}
    assert all(by[i][0].class_id == i and by[i][0].class_size == 1 for i in (4, 5, 6, 11))
    assert by[8][0].class_id == by[9][0].class_id == 8 and len(by[9]) == 2 and by[8][0].class_size == 3
    assert all(x.class_id is None and x.class_size == 1 and x.kept for x in by[None])
    kept = drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    # Rows without an id are dropped by their own text: one is a copy of row 1, the other is null.
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(["1", "4", "5", "6", "8", "10", "11", "None"])


def test_empty(spark, messy):
    assert near_duplicates(messy.limit(0)).collect() == []
    assert drop_near_duplicates(messy.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 400), (500, 450)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 450: 400, 500: 400}
