"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they
belong to). A flow network routes each pattern's words to the quotas of its
sources; every further repetition of a pattern costs more than the last, so
words are repeated only where a quota needs it, and evenly. Whole passes over
a pattern take every document; the rest of its flow takes documents in a
seeded order up to the cut, which is found by histogram, never by sorting a
pattern in one task. With ``fill`` the cut is repeated over the documents that
still fit, and subset sums over a small pool of each pattern close the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from legation.llm.common import cut, text_of

WORD = r"[^\x20\x09-\x0D]+"


def word_count(col: str) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], repeats: int = 3) -> dict[str | None, float]:
    """Share the sum of all sizes by weight; none gets more than ``repeats`` times its size.

    What a full source cannot take is shared again by weight among the others.
    """
    total, out = sum(sizes.values()), {s: 0.0 for s in sizes}
    open_ = {s for s in sizes if sizes[s] > 0}
    while open_:
        rest = total - sum(repeats * sizes[s] for s in sizes if sizes[s] > 0 and s not in open_)
        unit = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > repeats * sizes[s]}
        if not full:
            out.update({s: unit * weights[s] for s in open_})
            break
        out.update({s: float(repeats * sizes[s]) for s in full})
        open_ -= full
    return out


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 3) -> dict[tuple[int, object], int]:
    """Min-cost flow: words of pattern i that go to source s, as ``{(i, s): words}``.

    Pass r of a pattern costs 2**r per word, so first passes fill up before
    second ones. Sources that no chain of patterns links are networks of their
    own, so many sources without overlap cost no more than their number.
    """
    above = {s: s for s in quotas}

    def top(s):
        while above[s] != s:
            above[s] = s = above[above[s]]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            above[top(s)] = top(members[0])
    linked: dict = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            linked.setdefault(top(members[0]), ([], []))[0].append(i)
    for s in quotas:
        linked.setdefault(top(s), ([], []))[1].append(s)
    out = {}
    for numbers, sources in linked.values():
        flow = _route_linked([patterns[i] for i in numbers], {s: quotas[s] for s in sources}, repeats)
        out.update({(numbers[i], s): words for (i, s), words in flow.items()})
    return out


def _route_linked(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int) -> dict[tuple[int, object], int]:
    """Successive cheapest paths with potentials; the network has one node per pattern and source."""
    sources = list(quotas)
    base = 1 + len(patterns)
    sink = base + len(sources)
    at = {s: base + i for i, s in enumerate(sources)}
    graph: list[list[list]] = [[] for _ in range(sink + 1)]

    def arc(u: int, v: int, capacity: int, cost: int) -> list:
        there, back = [v, capacity, cost, None], [u, 0, -cost, None]
        there[3], back[3] = back, there
        graph[u].append(there)
        graph[v].append(back)
        return there

    routed = {}
    for i, (members, words) in enumerate(patterns):
        for r in range(repeats):
            arc(0, 1 + i, words, 1 << r)
        for s in members:
            routed[i, s] = arc(1 + i, at[s], repeats * words, 0)
    for s in sources:
        arc(at[s], sink, quotas[s], 0)
    potential = [0] * (sink + 1)
    while True:
        distance: list[float] = [float("inf")] * (sink + 1)
        distance[0], came, queue = 0, [None] * (sink + 1), [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            for edge in graph[u]:
                step = d + edge[2] + potential[u] - potential[edge[0]]
                if edge[1] > 0 and step < distance[edge[0]]:
                    distance[edge[0]], came[edge[0]] = step, edge
                    heapq.heappush(queue, (step, edge[0]))
        if distance[sink] == float("inf"):
            return {key: edge[3][1] for key, edge in routed.items()}
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance)]
        path, node = [], sink
        while node:
            path.append(came[node])
            node = came[node][3][0]
        flow = min(edge[1] for edge in path)
        for edge in path:
            edge[1] -= flow
            edge[3][1] += flow


def seeded(id_col: Column, seed: str) -> Column:
    """A 60-bit number drawn from the id: the order in which documents are taken."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _order() -> list[Column]:
    """The seeded order; rows that tie in all of it have one id and text, so it does not matter which is taken."""
    return [F.col("u"), F.col("id").asc_nulls_last(), F.col("size"), F.col("h")]


def _cut_bucket(rows: DataFrame, bucket: Column, left: DataFrame, level: int) -> DataFrame:
    """Per pattern the first bucket whose running total reaches what is left, and what is left before it."""
    sums = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("pattern").orderBy("bucket")  # 1024 buckets at most
    sums = sums.withColumn("upto", F.sum("words").over(running)).join(F.broadcast(left), "pattern")
    hit = sums.filter("upto >= rest and rest > 0").groupBy("pattern").agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("c"))
    return hit.select(
        "pattern", F.col("c.bucket").alias(f"cut{level}"), (F.col("c.rest") - F.col("c.upto") + F.col("c.words")).alias("rest")
    )


def _mark(rows: DataFrame, left: DataFrame, keep: tuple) -> DataFrame:
    """``keep`` and ``chosen``: 1 for the rows of each pattern that come first in seeded order and fit its ``rest``."""
    # Two histogram levels of ten bits narrow the cut down to a millionth of a pattern.
    first, second = F.shiftright("u", 50), F.shiftright("u", 40).bitwiseAND(F.lit(1023))
    cut1 = cut(_cut_bucket(rows, first, left.select("pattern", "rest"), 1), narrow=True)
    inside = rows.join(F.broadcast(cut1.select("pattern", "cut1")), "pattern").filter(first == F.col("cut1"))
    cut2 = cut(_cut_bucket(inside, second, cut1.select("pattern", "rest"), 2), narrow=True)
    cuts = cut1.select("pattern", "cut1").join(cut2, "pattern")  # a row per pattern
    placed = rows.join(F.broadcast(left.withColumnRenamed("rest", "whole")), "pattern", "left").join(
        F.broadcast(cuts), "pattern", "left"
    )
    last = (first == F.col("cut1")) & (second == F.col("cut2"))
    before = (first < F.col("cut1")) | ((first == F.col("cut1")) & (second < F.col("cut2")))
    running = Window.partitionBy("pattern").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.filter(last).withColumn("upto", F.sum("size").over(running))
    within = within.withColumn("chosen", (F.col("upto") <= F.col("rest")).cast("long"))
    # Without a cut the rest, if any, holds every row.
    decided = placed.filter(~F.coalesce(last, F.lit(False))).withColumn("chosen", F.coalesce(before, F.col("whole") > 0).cast("long"))
    return cut(reduce(DataFrame.union, [x.select(*keep, "chosen") for x in (decided, within)]))


def best_fill(sizes: list[int], room: int, copies: int) -> list[int]:
    """How often to take each of ``sizes``, ``copies`` times at most, for the largest total within ``room``.

    Of equal totals, one that needs the fewest copies of a size, then the
    first sizes.
    """
    by = np.full(room + 1, -1, np.int32)  # the step that first reached each total
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for step in range(copies * len(sizes)):
        size = sizes[step % len(sizes)]
        if reached[room]:
            break
        if 0 < size <= room:
            new = reached[:-size] & ~reached[size:]
            by[size:][new] = step
            reached[size:] |= new
    out, total = [0] * len(sizes), int(np.flatnonzero(reached)[-1])
    while total:
        at = by[total] % len(sizes)
        out[at] += 1
        total -= sizes[at]
    return out


def _close(pool: list[dict], gap: int, copies: int, most_words: int) -> list[tuple[int, int]]:
    """``(row, times)`` for the documents of a pattern's pool, chosen anew together with the gap."""
    pool = sorted(pool, key=lambda d: (d["u"], d["id"] is None, d["id"], d["size"], d["h"]))
    room, open_ = gap, []
    for i in sorted(range(len(pool)), key=lambda i: pool[i]["size"]):
        chosen = pool[i]["size"] * pool[i]["chosen"]
        if room + chosen <= most_words:
            room += chosen
            open_.append(i)
    if gap > most_words:
        return []
    open_.sort()
    times = best_fill([pool[i]["size"] for i in open_], room, copies)
    return [(pool[i]["row"], n) for i, n in zip(open_, times)]


def _closer(most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``gap, copies, pool`` rows to ``fixed, times`` rows, a pool at a time."""
        for batch in batches:
            for i in range(batch.num_rows):
                pattern = {name: batch.column(name)[i].as_py() for name in ("gap", "copies", "pool")}
                found = _close(pattern["pool"], pattern["gap"], pattern["copies"], most_words)
                fixed, times = ([x[k] for x in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(fixed, pa.int64()), pa.array(times, pa.int64())], names=["fixed", "times"])

    return run


def _per_pattern(spark, rows: list, columns: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, f"pattern string, {columns}"))


def _go_on(marked: DataFrame, gaps: dict[str, int], level: int, repeats: int) -> tuple[DataFrame, dict[str, int]]:
    """The cut again over documents taken ``level`` times that still fit, until none does; and what is left then."""
    gaps, open_, more, columns = dict(gaps), gaps, [], ("row", "id", "pattern", "size", "u", "h")
    spare = marked.filter((F.col("chosen") == level) & (F.col("passes") + level < repeats) & (F.col("size") > 0)).select(*columns)
    while open_:
        left = _per_pattern(marked.sparkSession, list(open_.items()), "rest long")
        spare = cut(spare.join(left, "pattern").filter("size <= rest").select(*columns), narrow=True)
        round_ = _mark(spare, left, columns)
        used = round_.filter("chosen = 1").groupBy("pattern").agg(F.sum("size").alias("used")).collect()
        for row in used:
            gaps[row["pattern"]] -= row["used"]
        if used:
            more.append(round_.filter("chosen = 1").select(F.col("row").alias("added")))
        open_ = {row["pattern"]: gaps[row["pattern"]] for row in used if gaps[row["pattern"]] > 0}
        spare = round_.filter("chosen = 0").select(*columns)
    if more:
        added = reduce(DataFrame.union, more)
        marked = marked.join(added, marked["row"] == added["added"], "left")
        marked = cut(marked.withColumn("chosen", F.col("chosen") + F.col("added").isNotNull().cast("long")).drop("added"))
    return marked, gaps


def _fill(marked: DataFrame, plan: list[tuple[str, int, int]], counts: dict[str, int], repeats: int, pool: int, most_words: int) -> DataFrame:
    """``marked`` with ``chosen`` as the number of times a document is taken beside the whole passes."""

    def gaps_of(frame: DataFrame) -> dict[str, tuple[int, int | None]]:
        """Per pattern below its part: what is left, and the smallest document that could be taken again."""
        again = F.min(F.when((F.col("size") > 0) & (F.col("passes") + F.col("chosen") < repeats), F.col("size")))
        facts = frame.groupBy("pattern").agg(F.sum(F.col("size") * F.col("chosen")).alias("used"), again.alias("least")).collect()
        left = {row["pattern"]: (rest[row["pattern"]] - row["used"], row["least"]) for row in facts}
        return {p: (gap, least) for p, (gap, least) in left.items() if gap > 0}

    rest, passes = {p: words for p, _, words in plan}, {p: n for p, n, _ in plan}
    gaps = {p: gap for p, (gap, _) in gaps_of(marked).items()}
    if not gaps:
        return marked

    # A pool of each pattern, all of it where it is small, drawn by the low bits of the id's number.
    # A part of a larger pattern repeats no document here, so that others come first.
    facts = [(p, gap, repeats - passes[p] if counts[p] <= pool else 1, min(1.0, 2 * pool / counts[p])) for p, gap in gaps.items()]
    few = marked.filter("size > 0").join(_per_pattern(marked.sparkSession, facts, "gap long, copies long, share double"), "pattern")
    few = few.withColumn("drawn", F.col("u").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).filter("drawn < share")
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("pattern").orderBy("drawn", *_order()))).filter(F.col("n") <= pool)
    pools = few.groupBy("pattern", "gap", "copies").agg(F.collect_list(F.struct("row", "id", "size", "u", "h", "chosen")).alias("pool"))
    closed = cut(pools.select("gap", "copies", "pool").mapInArrow(_closer(most_words), "fixed long, times long"), narrow=True)
    marked = marked.join(closed, marked["row"] == closed["fixed"], "left")
    marked = cut(marked.withColumn("chosen", F.coalesce("times", "chosen")).drop("fixed", "times"))

    # What a pool could not close takes more of the others, repeats last.
    open_ = {p: gap for p, (gap, least) in gaps_of(marked).items() if least is not None and least <= gap}
    for level in range(repeats if open_ else 0):
        marked, open_ = _go_on(marked, open_, level, repeats)
        open_ = {p: gap for p, gap in open_.items() if gap > 0}
    return marked


def mix_sources(
    docs: DataFrame,
    sources_of: Column,
    weights: list[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    repeats: int = 3,
    seed: str = "mix",
    max_patterns: int = 100_000,
    fill: bool = False,
    pool: int = 200,
    most_words: int = 4_000_000,
) -> tuple[DataFrame, dict]:
    """``(rows, targets)``: one row ``id, pattern, size, taken`` per document.

    ``sources_of`` is an array column: the sources a document belongs to.
    Sources are ordered by code point, null last, and weigh ``weights`` in
    turn. ``size`` is the number of words; the targets share all words by
    weight, none above ``repeats`` times the words of its source. ``taken``
    counts the words the mix takes, repeats included, at most ``repeats``
    times the size. The part of a pattern that is not a whole pass takes
    documents in seeded order as long as they fit, then the largest other
    document that fits what is left: a source's total never exceeds its
    target and misses it by less than its largest document. One document that
    does not fit ends the seeded order, so a small source can miss by much.

    With ``fill`` up to ``pool`` documents of the pattern (all of a pattern no
    larger, then repeats are allowed) are chosen anew for the largest total
    that fits: the best there is for patterns of up to ``pool`` documents
    whose part holds up to ``most_words`` words. A pool with more chosen words
    keeps its largest chosen documents as they are. Where that leaves room,
    the seeded order goes on behind documents that do not fit, repeats last:
    in the end no document that may be taken once more fits what is left.

    The driver holds one count per pattern; more than ``max_patterns``
    patterns are refused. Null or blank texts have size 0 and take 0; a
    document without sources takes 0; repeated rows count each; rows without
    an id are drawn by their text. Documents are ordered by the draw, id, size
    and a hash of the text, whatever the partitioning, so reruns agree; rows
    equal in all of these are interchangeable. An empty table gives no rows
    and no targets. Other columns are ignored.
    """
    sized = cut(docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.to_json(F.struct(F.array_sort(F.array_distinct(sources_of)).alias("s"))).alias("pattern"),
        F.array_sort(F.array_distinct(sources_of)).alias("members"),
        word_count(text_col).alias("size"),
        # Rows without an id are spread by their text.
        seeded(F.coalesce(F.col(id_col).cast("string"), F.md5(text_of(text_col).cast("binary"))), seed).alias("u"),
        F.xxhash64(text_of(text_col)).alias("h"),
        F.monotonically_increasing_id().alias("row"),  # fixed once written
    ))
    found = sized.groupBy("pattern").agg(
        F.any_value("members").alias("members"), F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("docs")
    )
    found = found.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found = sorted(found, key=lambda row: row["pattern"])
    patterns = [(tuple(row["members"] or ()), row["words"]) for row in found]
    names = {s for members, _ in patterns for s in members}
    order = sorted((s for s in names if s is not None)) + [None] * (None in names)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    sizes = dict.fromkeys(order, 0)
    for members, words in patterns:
        for s in members:
            sizes[s] += words
    goal = targets(sizes, weight, repeats)
    flow = route(patterns, {s: int(goal[s]) for s in order}, repeats)
    taken = [sum(flow[i, s] for s in members) for i, (members, _) in enumerate(patterns)]
    plan = [
        (row["pattern"], words_taken // row["words"] if row["words"] else 0, words_taken % row["words"] if row["words"] else 0)
        for row, words_taken in zip(found, taken)
    ]
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("passes", T.LongType()), T.StructField("rest", T.LongType())])
    passes = spark.createDataFrame(plan, schema)

    marked = _mark(sized, passes.select("pattern", "rest"), ("row", "id", "pattern", "members", "size", "u", "h"))
    marked = marked.join(F.broadcast(passes.select("pattern", "passes")), "pattern")
    if fill:
        counts = {row["pattern"]: row["docs"] for row in found}
        marked = _fill(marked, plan, counts, repeats, pool, most_words)
        rows = marked.select("id", "pattern", "members", "size", (F.col("size") * (F.col("passes") + F.col("chosen"))).alias("taken"))
        return rows, {"sizes": sizes, "targets": goal}

    # One more document per pattern, the largest that still fits, closes the gap before the cut.
    used = marked.groupBy("pattern").agg(F.sum(F.col("size") * F.col("chosen")).alias("used"))
    gap = used.join(F.broadcast(passes), "pattern").select("pattern", (F.col("rest") - F.col("used")).alias("gap"))
    spare = marked.filter("chosen = 0 and size > 0").join(F.broadcast(gap), "pattern").filter("size <= gap")
    filler = spare.groupBy("pattern").agg(F.max(F.struct("size", (-F.col("u")).alias("v"), "id", "h", "row")).alias("best"))
    filler = filler.select(F.col("best.row").alias("fill"))  # a row per pattern
    filled = marked.join(F.broadcast(filler), marked["row"] == filler["fill"], "left")
    times = F.col("passes") + F.col("chosen") + F.col("fill").isNotNull().cast("long")
    rows = filled.select("id", "pattern", "members", "size", (F.col("size") * times).alias("taken"))
    return rows, {"sizes": sizes, "targets": goal}


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: ``<id>, size, source_size, target, taken`` for single-source documents.

    Weights, targets, nulls, ties and repeated rows as in :func:`mix_sources`;
    the null source is a source of its own, ordered last. ``fill`` and other
    options as there.
    """
    weights = options.pop("weights", [5, 2, 1])
    rows, found = mix_sources(docs, F.array(F.col(source_col).cast("string")), weights, id_col, text_col, **options)
    facts = [(s, int(found["sizes"][s]), float(found["targets"][s])) for s in found["sizes"]]
    schema = T.StructType([T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    named = docs.sparkSession.createDataFrame(facts, schema)  # a row per source
    rows = rows.withColumn("of", F.element_at("members", 1)).withColumnRenamed("id", id_col)
    out = rows.join(F.broadcast(named), rows["of"].eqNullSafe(named["of"]), "left")
    return out.select(id_col, "size", "source_size", "target", "taken")
