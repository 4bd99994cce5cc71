"""The prefix trie against a plain Python trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from legation.llm import prefix_trie as trie
from legation.llm.prefix_trie import ID, LAYOUTS, Node, common, insert, prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:ID])
            turns.setdefault(conv, []).append((order, (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for seq, convs in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += seq not in kids
            saved[seq[:d]] += (len(convs) - 1) * (len(seq[-1][1].split()) if seq else 0)
    out = []
    for seq, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(seq))
        up = min(members[seq[:-1]]) if seq else None
        out.append((min(convs), len(seq), up, len(convs), len(kids.get(seq, [])), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema=COLUMNS):
    return sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str)


def random_rows(seed, convs, words=4, longest=6):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(convs * 3), convs):
        rows += [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "b c", "", None, "d  e f"][:words])) for t in range(r.randint(1, longest))]
    return rows


@pytest.mark.parametrize("seed, convs, words", [(1, 60, 5), (2, 400, 2), (3, 25, 1), (4, 700, 5)])
def test_matches_plain_trie(spark, seed, convs, words):
    rows = random_rows(seed, convs, words)
    assert got(spark, rows) == brute(rows)


def test_many_small_ranges(spark):
    """Far more ranges than children: every node is cut, many ranges hold one conversation or none."""
    rows = random_rows(7, 90, 3, 9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_and_a_hot_first_turn(spark):
    """Thousands of copies of one conversation cross ranges; their ids are digested in order."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 40_000, 20) for t in range(3)]
    rows += [(c, t, "user", f"turn {t if t == 0 else c}") for c in range(50_000, 51_000) for t in range(2)]
    assert got(spark, rows) == brute(rows)


def test_messy_rows(spark):
    rows = [
        (20, None, None, None), (20, 1, "user", "x y"), (20, 1, "user", "x y"), (20, 1, "bot", "z"),
        (21, 5, "user", "own"), (33, 0, "user", "no family"), (-7, 0, "user", "x y"), (None, 0, "user", "dropped"),
        (40, 0, "user", "word " * 30_000), (41, 0, "user", "é ☃\tπ"), (60, 0, "us", "er: a"), (61, 0, "use", "r: a"),
    ]
    # Python's modulo differs from SQL's below zero: -7 % 20 is -7 there, so its family is 0.
    assert [r for r in got(spark, rows) if r[0] != -7 and r[1] > 0] == [r for r in brute(rows) if r[0] != -7 and r[1] > 0]
    wide = [(*r, "clash", 1) for r in rows]
    assert got(spark, wide, COLUMNS + ", depth string, key int") == got(spark, rows)
    assert got(spark, []) == []


def test_deep_chain(spark):
    """Every conversation goes one turn further than the one before."""
    rows = [(20 * c, t, "u", f"{t}") for c in range(60) for t in range(c)]
    assert got(spark, rows) == brute(rows)


def test_node_layouts():
    """Nodes grow through every layout and find all their children."""
    root = Node(b"")
    for i in range(256):
        insert(root, bytes([i]) * ID, i)
        assert root.layout == min(n for n in LAYOUTS if n > i)
        assert all(root.find(j).members[0] == j for j in range(i + 1))
        assert all(root.find(j) is None for j in range(i + 1, 256))


def test_path_compression():
    root = Node(b"")
    a, b = bytes(range(32)), bytes(range(20)) + bytes(12)
    insert(root, a, 1)
    insert(root, b, 2)
    upper = root.find(0)
    assert upper.path == a[:20] and {kid.path for kid in upper.children()} == {a[20:], b[20:]}
    assert common(b"abc", b"abd") == 2 and common(b"", b"x") == 0 and common(b"ab", b"abc") == 2 and common(b"\0\1", b"\1\1") == 0
    out = trie.emit(root, a, b, dict.fromkeys([a[:16], a[16:], b[16:]], 1), 0)
    assert {row[2] for row in out.rows} == {0, 1, 2}
