"""Quality, mixing, URL lists, archives, the pipeline, and the registered queries."""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import random
import re
import zlib

import pytest
from conftest import SMOKE_DIR
from llm_helpers import messy, prose  # noqa: F401
from oracle_compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from legation.llm import mixing
from legation.llm.oracle import ORACLE
from legation.llm.quality import classify, statistics
from legation.llm.queries import QUERIES
from legation.llm.url_lists import list_keys, url_verdicts
from legation.llm.warc import archive_round_trip, build_index, lookup, parse_record, url_key, write_archives

needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="driver tables not present")


# -- quality


def labelled(n=400):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose(i, 40 + i % 50).capitalize() + "."
        docs.append((i, text if good else text.upper().replace(" ", " $$$ ") + "!!"))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark, messy):
    docs, labels = labelled()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(0, 1), (7, None), (None, 1), (8, 5), (1, 1)], "doc_id long, quality int")
    out = classify(frame, known).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(out) == len(docs)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    # Held-out labels are never learnt from: turning them round changes no score.
    turned = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classify(frame, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)
    for rows in (classify(messy, known).collect(), classify(messy, known.limit(0)).collect()):
        assert len(rows) == messy.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert classify(messy.limit(0), known).collect() == []


def test_statistics_of_odd_texts():
    import numpy as np
    import pyarrow as pa

    x = statistics(pa.array([None, "", "a", "\n\n", "é" * 100_000, "$"]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


# -- mixing


def brute_targets(sizes, weights, repeats=3):
    goal, open_, rest = dict.fromkeys(sizes, 0.0), [s for s in sizes if sizes[s]], float(sum(sizes.values()))
    while open_:
        over = [s for s in open_ if rest * weights[s] / sum(weights[t] for t in open_) > repeats * sizes[s]]
        if not over:
            for s in open_:
                goal[s] = rest * weights[s] / sum(weights[t] for t in open_)
            return goal
        for s in over:
            goal[s] = repeats * sizes[s]
            rest -= goal[s]
            open_.remove(s)
    return goal


def test_targets():
    r = random.Random(1)
    for _ in range(100):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 100_000]) for i in range(r.randint(1, 9))}
        weights = {s: r.choice([5, 2, 1]) for s in sizes}
        got, want = mixing.targets(sizes, weights), brute_targets(sizes, weights)
        assert all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in sizes)
        if sum(sizes.values()):
            assert abs(sum(got.values()) - sum(sizes.values())) < 1e-3


def test_flow_over_overlapping_sources():
    patterns = [(("a",), 10), (("a", "b"), 20), (("b", "c"), 10), ((), 5)]
    flow = mixing.route(patterns, {"a": 30, "b": 30, "c": 8})
    by_source = {s: sum(v for (_, t), v in flow.items() if t == s) for s in "abc"}
    by_pattern = [sum(v for (i, _), v in flow.items() if i == p) for p in range(4)]
    assert by_source == {"a": 30, "b": 30, "c": 8}
    assert all(taken <= 3 * words for taken, (_, words) in zip(by_pattern, patterns))
    # First passes are full before any second one is paid for: least total cost of 68 words over 40.
    cost = sum((1 << r) * max(0, min(w, t - r * w)) for t, (_, w) in zip(by_pattern, patterns) for r in range(3))
    assert cost == 40 + 2 * 28


def test_flow_by_linked_sources_is_the_whole_flow():
    r = random.Random(3)
    for _ in range(60):
        sources = [f"s{i}" for i in range(r.randint(1, 7))] + [None]
        patterns = [(tuple(r.sample(sources, r.randint(0, min(3, len(sources))))), r.choice([0, 1, 7, 40])) for _ in range(r.randint(0, 8))]
        quotas = {s: r.choice([0, 3, 20, 90]) for s in sources}
        parts, whole = mixing.route(patterns, quotas), mixing._route_linked(patterns, quotas, 3)
        assert parts.keys() == whole.keys()

        def price(flow):
            taken = [sum(v for (i, _), v in flow.items() if i == p) for p in range(len(patterns))]
            return sum(taken), sum((1 << n) * max(0, min(w, t - n * w)) for t, (_, w) in zip(taken, patterns) for n in range(3))

        assert price(parts) == price(whole)
    many = {f"s{i}": 30 for i in range(20_000)}
    flow = mixing.route([((s,), 20) for s in many], many)
    assert len(flow) == 20_000 and set(flow.values()) == {30}


def test_mix_rows(spark, messy):
    docs = [(i, prose(i, 1 + i * 7 % 90), f"s{i % 5}" if i % 3 else "s0") for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix_by_source(frame).collect()
    assert sorted(out) == sorted(mixing.mix_by_source(frame.repartition(7)).collect())
    taken, goal, source = {}, {}, {d[0]: d[2] for d in docs}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = source[r.doc_id]
        taken[s], goal[s] = taken.get(s, 0) + r.taken, r.target
    # Never above the target, below it by less than the largest document.
    assert all(0 <= goal[s] - taken[s] < 91 for s in goal)
    rows = mixing.mix_by_source(messy).collect()
    assert len(rows) == messy.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_by_source(messy.limit(0)).collect() == []


def test_best_fill():
    r = random.Random(5)
    for _ in range(200):
        sizes, room, copies = [r.randint(0, 12) for _ in range(r.randint(1, 5))], r.randint(0, 60), r.randint(1, 3)
        got = mixing.best_fill(sizes, room, copies)
        sums = {sum(a * b for a, b in zip(n, sizes)) for n in itertools.product(range(copies + 1), repeat=len(sizes))}
        assert all(0 <= n <= copies for n in got)
        assert sum(a * b for a, b in zip(got, sizes)) == max(x for x in sums if x <= room)


def misses(out, source):
    """Per source: words short of the target, and whether a document with a repeat left would still fit."""
    gap = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = source[r.doc_id]
        gap[s] = gap.get(s, int(r.target)) - r.taken
    return gap, {source[r.doc_id] for r in out if 0 < r.size <= gap[source[r.doc_id]] and r.taken < 3 * r.size}


def test_mix_goes_on_behind_a_document_that_does_not_fit(spark):
    """Each source has one document far longer than the others, in one pool and in several rounds."""
    docs = [(i, prose(i, 300 if i < 2 else 1 + i * 7 % 50), f"s{i % 2}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    source = {d[0]: d[2] for d in docs}
    assert not any(misses(mixing.mix_by_source(frame, fill=True).collect(), source)[0].values())
    gap, fits = misses(mixing.mix_by_source(frame, fill=True, pool=3).collect(), source)
    assert not fits and all(0 <= g < 20 for g in gap.values())


def best_total(sizes, room, copies):
    """The largest total within ``room`` of sizes taken up to ``copies`` times each."""
    sums = {0}
    for size in sizes:
        sums |= {x + n * size for x in sums for n in range(1, copies + 1) if x + n * size <= room}
    return max(sums)


@needs_tables
def test_mix_query_against_plain_python(spark):
    """Targets by water filling; each source takes the largest total that its documents can make of its part."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    of = {}
    for i, r in docs.items():
        of.setdefault(r.source, []).append(i)
    order = sorted(s for s in of if s is not None) + [None] * (None in of)
    words = {s: sum(size[i] for i in of[s]) for s in order}
    goal = brute_targets(words, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)})
    out = {r.doc_id: r for r in QUERIES["op7_mix_sources"](spark, SMOKE_DIR).collect()}
    assert out.keys() == docs.keys()
    for s in order:
        passes, rest = divmod(int(goal[s] + 1e-6), words[s])
        taken = sum(out[i].taken for i in of[s])
        assert taken == passes * words[s] + best_total([size[i] for i in of[s]], rest, 3 - passes)
        for i in of[s]:
            r = out[i]
            assert (r.size, r.source_size) == (size[i], words[s]) and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
            assert r.taken % max(r.size, 1) == 0 and passes * r.size <= r.taken <= 3 * r.size


def test_mix_reruns_agree_without_ids(spark):
    """Null and repeated ids: the same rows are taken however the rows are dealt."""
    rows = [(None if i % 3 else i % 20, prose(i, 1 + i * 13 % 70), f"s{i % 2}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("text_too", F.col("text"))
    results = set()
    for n in (1, 5, 16):
        for options in ({"fill": True}, {"fill": True, "pool": 20}, {}):
            out = mixing.mix_by_source(frame.repartition(n), **options).collect()
            results.add((str(options), str(sorted(out, key=str))))
    assert len(results) == 3


@needs_tables
def test_pipeline_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    gap, fits = misses(dict(corpus_pipeline.STAGES)["mix"](spark, docs, SMOKE_DIR).collect(), dict(docs.select("doc_id", "source").collect()))
    assert not fits and gap["src19"] == 0 and sum(gap.values()) < 200  # 4,124 words when the first misfit ends the order


def test_mix_overlaps(spark):
    rows = [(i, prose(i, 20), ["x"] if i % 4 else ["x", "y"]) for i in range(200)] + [(900, "no source", [])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    out, found = mixing.mix_sources(frame, F.col("member"), [1, 1])
    total = {r.pattern: 0 for r in out.collect()}
    for r in out.collect():
        total[r.pattern] += r.taken
    assert found["sizes"] == {"x": 4000, "y": 1000} and len(total) == 3
    assert abs(sum(total.values()) - sum(found["targets"].values())) <= 40 and sorted(total.values())[0] == 0


# -- URL lists


def test_keys(spark):
    urls = {
        "HTTP://u:p@Blog.Example.COM:80/a/b?x#y": ["blog.example.com", "example.com", "com", "blog.example.com/a"],
        "example.com": ["example.com", "com"],
        "https://example.com./": ["example.com", "com"],
        "": [], "http:///x": [], "http://" + "a." * 200 + "com/": [],
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", list_keys(F.col("url")).alias("k"))
    assert {r.url: r.k for r in df.collect()} == urls


def test_verdicts_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.org", "d.c.org"]
    changes = [(r.choice(hosts + ["a.com/x"]), r.choice(["block", "allow"]), r.choice(["p", None]), r.randint(0, 400_000), r.choice(["add", "add", "remove"])) for _ in range(80)]
    changes += [(None, "block", "p", 5, "add"), ("a.com", "block", "p", None, "add"), *changes[:5]]
    pages = [(i, f"http://{r.choice(hosts)}/{r.choice('xy')}", r.randint(0, 500_000), "extra") for i in range(300)]
    pages += [(900, None, 5, "e"), (901, "http://a.com/", None, "e"), (0, *pages[0][1:])]

    def brute(url, at):
        if url is None or at is None:
            return ("none", None, None, None, None, 0)
        host, seg = url[7:].split("/")
        keys = {host[i:] for i in range(len(host)) if i == 0 or host[i - 1] == "."} | ({f"{host}/{seg}"} if seg else set())
        active = []
        for stream in {c[:3] for c in changes if c[0] in keys}:
            times = sorted({c[3] for c in changes if c[:3] == stream and c[3] is not None})
            before = [t for t in times if t <= at]
            if before and not any(c[:4] == (*stream, before[-1]) and c[4] == "remove" for c in changes):
                later = [t for t in times if t > at]
                active.append((-len(stream[0]), stream[1] != "block", stream[2] is not None, stream[2] or "", stream, before[-1], later[0] if later else None))
        if not active:
            return ("none", None, None, None, None, 0)
        best = min(active, key=lambda x: x[:4])
        return (best[4][1], best[4][0], best[4][2], best[5], best[6], len(active))

    got = url_verdicts(
        spark.createDataFrame(pages, "page_id long, url string, fetched_at long, verdict string"),
        spark.createDataFrame(changes, "key string, verdict string, category string, at long, action string"),
        bucket_seconds=50_000,
    )
    assert got.count() == len(pages)
    for row in got.collect():
        assert tuple(row)[3:] == brute(row.url, row.fetched_at), row
    none = spark.createDataFrame([], "key string, verdict string, category string, at long, action string")
    frame = spark.createDataFrame(pages, "page_id long, url string, fetched_at long, e string")
    assert {r.verdict for r in url_verdicts(frame, none).collect()} == {"none"}
    assert url_verdicts(frame.limit(0), none).collect() == []


# -- archives

PAGES = [
    (3, "http://b.example.com/x?q=1", "<p>one</p>", "e"), (1, "https://example.com/", "<p>one</p>", "e"), (2, "http://b.example.com/x", "", "e"),
    (4, None, None, None), (5, "http://é.example/ a\r\nb", "é\r\n\r\nWARC/1.1\r\n", "e"), (6, "http://big.example/", prose(3, 30_000), "e"),
    (None, "http://example.com/", "<p>one</p>", "e"), (1, "https://example.com/", "<p>one</p>", "e"),
]


def test_round_trip(spark, workdir):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, key string")
    got = archive_round_trip(pages, workdir, file_bytes=200)
    key = lambda r: tuple((v is not None, v) for v in r)
    want = []
    for page, _, html, _ in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "").encode() == payload and p is not None]
        first = min(same)
        revisit = page is not None and page != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert archive_round_trip(pages.limit(0), workdir).collect() == []


def test_lookup_by_url(spark, workdir):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}", f"<p>{i}</p>") for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    entries = write_archives(pages, workdir)
    top = build_index(entries, workdir, block_entries=9)
    wanted = spark.createDataFrame([("http://h3.example.com/p10",), ("http://nowhere/",)], "url string").select(url_key(F.col("url")).alias("key"), F.lit(None).cast("long").alias("id"))
    found = lookup(wanted, workdir, top, whole_key=True).collect()
    assert sorted(r.id for r in found) == [i for i, u, _ in rows if u == "http://h3.example.com/p10"]
    exact = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").alias("id"))
    assert lookup(exact, workdir, top).count() == 700
    import gzip

    row = found[0]
    with open(f"{workdir}/{row.file}", "rb") as f:
        f.seek(row.offset)
        headers, payload, _ = parse_record(gzip.decompress(f.read(row.length)))
    assert headers["WARC-Type"] == "response" and payload.decode() == f"<p>{row.id}</p>"


def test_short_payloads_are_all_responses(spark, workdir):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string, key string")
    assert {r.record_type for r in archive_round_trip(pages, workdir, min_bytes=1000).collect()} == {"response"}


# -- pipeline and queries


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    out = compare(spark, duck(SMOKE_DIR), name, QUERIES[name], ORACLE[name], SMOKE_DIR)
    assert out.ok, out.detail


@needs_tables
def test_pipeline_stages(spark):
    """Each stage keeps exactly what its operator's rule says of its own input."""
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SMOKE_DIR).cache()
        if name != "mix":
            assert out.columns == docs.columns and out.count() <= seen.count()
        if name == "exact_dedup":
            normal = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
            assert sorted(r.doc_id for r in out.collect()) == sorted(r[1] for r in seen.groupBy(normal).agg(F.min("doc_id")).collect())
        if name == "decontaminate":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").collect()]
            left = {r.doc_id for r in out.collect()}
            for r in seen.collect():
                text = " ".join((r.text or "").lower().split())
                assert r.doc_id not in left or not any(item in text for item in items)
        seen = out
    assert sorted(corpus_pipeline.run(spark, SMOKE_DIR).collect()) == sorted(seen.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_messy_and_empty_input(spark, messy, stage):
    for docs in (messy, messy.limit(0)):
        out = stage(spark, docs, SMOKE_DIR)
        assert len(out.collect()) <= docs.count()


def test_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and {*QUERIES, "pipeline"} <= set(queries())
    assert set(ORACLE) <= set(oracle_sql())
