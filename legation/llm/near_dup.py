"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A document is its weighted set of word shingles. Each shingle starts a
Poisson process whose rate is its weight and whose points fall on random
registers; a register keeps the shingle that arrives first, so two documents
agree in a register with the probability Jaccard similarity

    J_P = sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i).

Processes stop as soon as their next arrival is later than the last register's.
Registers are banded; documents that share a band are linked if an exact
comparison of their shingles reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, cut, row_keys, text_of
from legation.llm.components import components
from legation.llm.words import mix, shingles, word_hashes

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def weighted_shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights 1 + ln(count)."""
    found, counts = np.unique(shingles(words, k), return_counts=True)
    return found, 1.0 + np.log(counts)


def signature(found: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register (``registers`` a power of two)."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    seeds, rates, now, step = found, weights, np.zeros(len(found)), 0
    while len(seeds):
        # Points drawn at once: about what all registers need, one each for long texts.
        width = max(1, int(registers * (np.log(registers) + 2) / len(seeds)))
        draws = mix(seeds[:, None] + _GOLDEN * np.arange(step + 1, step + width + 1, dtype=np.uint64))
        gaps = -np.log1p(-(draws >> _U(11)).astype(np.float64) * 2.0**-53)
        times = now[:, None] + np.cumsum(gaps, axis=1) / rates[:, None]
        near = times < first.max()
        where = (draws & _U(registers - 1)).astype(np.intp)[near]
        at, who = times[near], np.broadcast_to(seeds[:, None], times.shape)[near]
        if np.isinf(first.max()) and len(at) > 8 * registers:
            # Early arrivals settle most registers; later ones can then be skipped.
            bound = registers * (np.log(registers) + 1) / rates.sum()
            soon = at <= bound
            _settle(first, owner, where[soon], at[soon], who[soon])
            late = ~soon & (at < first.max())
            where, at, who = where[late], at[late], who[late]
        _settle(first, owner, where, at, who)
        now, step = times[:, -1], step + width
        alive = now < first.max()
        seeds, rates, now = seeds[alive], rates[alive], now[alive]
    return owner


def _settle(first: np.ndarray, owner: np.ndarray, where: np.ndarray, at: np.ndarray, who: np.ndarray) -> None:
    order = np.argsort(at)[::-1]  # the earliest is assigned last
    best, by = np.full(len(first), np.inf), np.zeros(len(first), np.uint64)
    best[where[order]], by[where[order]] = at[order], who[order]
    sooner = best < first
    first[sooner], owner[sooner] = best[sooner], by[sooner]


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the exact probability Jaccard and plain Jaccard similarities."""
    (xs, xw), (ys, yw) = x, y
    common, i, j = np.intersect1d(xs, ys, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(xs) + len(ys) - len(common))
    # For ratios r_j = x_j / y_j sorted, sum_j max(x_j / x_i, y_j / y_i) splits at r_i:
    # terms with r_j >= r_i count x_j / x_i, the others y_j / y_i.
    cx, cy = xw[i], yw[j]
    order = np.argsort(cx / cy)
    cx, cy = cx[order], cy[order]
    above = np.cumsum(cx[::-1])[::-1] + (xw.sum() - cx.sum())
    below = np.concatenate(([0.0], np.cumsum(cy)[:-1])) + (yw.sum() - cy.sum())
    return max(plain, float((1.0 / (above / cx + below / cy)).sum()))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _bands(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``id, same, bands``: a hash of the whole word sequence and one per band (null without words)."""
    registers = 1 << (bands * rows - 1).bit_length()
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            words, first = word_hashes(batch.column(1))
            same, out = [], []
            for i in range(batch.num_rows):
                own = words[first[i] : first[i + 1]]
                if not len(own):
                    same.append(None)
                    out.append(None)
                    continue
                place = mix(np.arange(1, len(own) + 1, dtype=np.uint64) * _GOLDEN)
                same.append(int(_signed(mix(np.array([(own * place).sum() + _U(len(own))])))[0]))
                owner = signature(*weighted_shingles(own, k), registers)[: bands * rows].reshape(bands, rows)
                band = salts.copy()
                for r in range(rows):
                    band = mix(band * _GOLDEN + owner[:, r])
                out.append(_signed(band))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "same", "bands"]
            )

    return docs.mapInArrow(run, "id long, same long, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``pairs`` (a < b) with ``linked``: whether the whole texts are similar enough."""
    left = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in chunks([whole], "text_a", 1 << 20):
                for batch in chunks([half], "text_b", 1 << 20):
                    sides = []
                    for column in (2, 3):
                        words, first = word_hashes(batch.column(column))
                        sides.append((words, first))
                    (wa, fa), (wb, fb) = sides
                    seen: dict[int, tuple] = {}
                    linked = []
                    ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    for i, (a, b) in enumerate(zip(*ids)):
                        if a not in seen:
                            seen[a] = weighted_shingles(wa[fa[i] : fa[i + 1]], k)
                        if b not in seen:
                            seen[b] = weighted_shingles(wb[fb[i] : fb[i + 1]], k)
                        linked.append(similarity(seen[a], seen[b]) >= threshold)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
                    )

    return both.mapInArrow(run, "a long, b long, linked boolean")


# Each mask orders a bucket's members differently; the first in each order is a pivot.
_MASKS = (0, -1, 0x5555555555555555, 0x3333333333333333)


def _pairs(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _own_parts(texts: DataFrame, k: int) -> DataFrame:
    """``id, n, u, mass``: shingles, those in no other of these texts, and the latter's share of the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            words, first = word_hashes(batch.column(1))
            for i, page in enumerate(batch.column(0).to_pylist()):
                found, weights = weighted_shingles(words[first[i] : first[i + 1]], k)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, page, np.int64)),
                        pa.array([*_signed(found).tolist(), None], pa.int64()),  # the last row holds the totals
                        pa.array(np.append(weights, weights.sum())),
                        pa.array(np.full(n + 1, n, np.int64)),
                    ],
                    names=["id", "shingle", "weight", "n"],
                )

    rows = texts.mapInArrow(run, "id long, shingle long, weight double, n long")
    total = F.col("shingle").isNull()
    once = rows.groupBy("shingle", F.when(total, F.col("id")).alias("of")).agg(
        F.count(F.lit(1)).alias("in"), F.min("id").alias("id"), F.min("weight").alias("weight"), F.min("n").alias("n")
    ).filter("in = 1")
    alone = once.groupBy("id").agg(
        F.max("n").alias("n"),
        F.count_if(~total).alias("u"),
        F.max(F.when(total, F.col("weight"))).alias("total"),
        F.coalesce(F.sum(F.when(~total, F.col("weight"))), F.lit(0.0)).alias("own"),
    )
    return alone.select("id", "n", "u", "total", (F.col("own") / F.col("total")).alias("mass"))


def _bitmaps(texts: DataFrame, k: int, words_: int = 32) -> DataFrame:
    """``id, bits``: per bit, whether an odd number of the text's shingles fall on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            words, first = word_hashes(batch.column(1))
            bits = []
            for i in range(batch.num_rows):
                found, _ = weighted_shingles(words[first[i] : first[i + 1]], k)
                at = (found >> _U(20)).astype(np.int64) % (64 * words_)
                odd = np.bincount(at, minlength=64 * words_) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["id", "bits"])

    return texts.mapInArrow(run, "id long, bits array<long>")


def _reachable(threshold: float) -> Column:
    """Whether two texts can be similar enough; false only where that is impossible.

    Plain: of n shingles the u found in one text alone are not common.
    Weighted: each term of J_P is at most 1 / (1 / x_i + q / y_i) for weights
    that sum to 1, with q the weight of y's shingles outside x. That is concave
    and homogeneous, so J_P <= 1 / (1 / a + 1 / b - 1) with a and b the common
    shares of x's and y's weight. Bitmaps: differing bits never outnumber the
    shingles on one side only; each of these weighs 1 at least.
    """
    common = F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu"))
    plain = common >= threshold * (F.col("n") + F.col("pn") - common) - 1e-9
    a, b = 1 - F.col("mass"), 1 - F.col("pmass")
    weighted = (a > 0) & (b > 0) & (a * b >= (threshold - 1e-9) * (a + b - a * b))
    differing = F.aggregate(F.zip_with("bits", "pbits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    room = 2 * (1 - threshold) / (1 + threshold)
    return (plain | weighted) & (differing <= room * F.greatest("total", "ptotal") + 1e-9)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    bands: int = 16,
    rows: int = 4,
) -> DataFrame:
    """One row per document: ``<id>, class_id, class_size, n_links, kept``.

    Two documents are linked when their word sequences are equal or the
    similarity of their ``k``-word shingles reaches ``threshold``; a class is
    a connected component, ``class_id`` its smallest id and ``kept`` marks
    that document. Documents with one word sequence are compared once, by
    their smallest id; ``n_links`` counts the verified links of that
    representative with others.

    Candidates are the pairs that share a bucket of a band. First every member
    of a bucket is compared with a few pivots, then, where several components
    are left, with the member that has the least text of its own (the likely
    origin of the copies). What is still outside a bucket's main component is
    compared with every member of other components, save those pairs that the
    shingles found in one text alone prove to be too different. So no link
    inside a bucket is lost, and a bucket of many copies costs a few
    comparisons per member.

    Texts without words, null ones included, are never near-duplicates: each
    is a class of its own. Rows without an id form classes of their own
    (``class_id`` null); repeated ids count as one document with its
    smallest text. Other columns are ignored, an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    hashed = cut(_bands(source, k, bands, rows))
    named = hashed.filter("id is not null")
    repeated = cut(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), narrow=True)
    if not repeated.isEmpty():
        single = source.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        named = cut(named.join(repeated, "id", "left_anti").union(_bands(single, k, bands, rows)))
    named = named.filter("same is not null")
    # Key tables are written before they are joined back, so that a hot key's rows can be split.
    groups = cut(named.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), narrow=True)
    member = named.join(groups.select(F.col("same").alias("of"), "rep"), F.col("same") == F.col("of"), "left")
    member = cut(member.select("id", F.coalesce("rep", "id").alias("rep"), F.when(F.coalesce("rep", "id") == F.col("id"), F.col("bands")).alias("bands")), narrow=True)
    buckets = member.select("id", F.explode("bands").alias("bucket"))

    pivots = [F.min(F.col("id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"p{i}") for i, m in enumerate(_MASKS)]
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *pivots).filter("n > 1")
    shared = cut(shared.select("bucket", F.array_distinct(F.array(*[f"p{i}" for i in range(len(_MASKS))])).alias("pivots")), narrow=True)
    inside = cut(buckets.join(shared, "bucket").select("bucket", "id", "pivots"), narrow=True)

    texts = source.filter("id is not null").join(inside.select("id").distinct(), "id", "left_semi")
    texts = cut(texts.groupBy("id").agg(F.min("text").alias("text")))
    pairs = inside.select("id", F.explode("pivots").alias("pivot")).filter("id != pivot")
    tried = cut(_verified(pairs.select(*_pairs("id", "pivot")).distinct(), texts, k, threshold), narrow=True)

    open_ = _open_buckets(inside.select("bucket", "id").distinct(), tried)
    if not open_.isEmpty():
        tried = _complete(open_, tried, texts, k, threshold)
    links = cut(tried.filter("linked").select("a", "b"), narrow=True)

    final = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    of_rep = cut(final.join(degree, final["node"] == degree["id"]).select(F.col("node").alias("rep"), "component", "n_links"), narrow=True)
    placed = member.join(of_rep, "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    return _result(hashed, placed.distinct(), id_col)


def _complete(open_: DataFrame, tried: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """``tried`` with every further comparison that the open buckets still need."""
    left = texts.join(open_.select("id").distinct(), "id", "left_semi")
    parts = _own_parts(left, k).join(_bitmaps(left, k), "id")
    # A text with more than the threshold leaves for itself alone has no link at all.
    parts = cut(parts.filter((F.col("n") - F.col("u") >= threshold * F.col("n") - 1e-9) | (1 - F.col("mass") >= threshold - 1e-9)), narrow=True)
    known = _known(open_, parts)
    hub = known.groupBy("bucket").agg(F.min(F.struct("mass", *(c for c in _PARTNER if c != "mass"))).alias("h"))
    second = _untried(known, hub.select("bucket", *_partner("h.")), tried, threshold, everyone=False)
    tried = cut(tried.union(_verified(second, texts, k, threshold)), narrow=True)

    open_ = _open_buckets(known.select("bucket", "id"), tried)
    known = _known(open_, parts)
    sizes = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    main = cut(sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("m")), narrow=True)
    outside = known.join(main, "bucket").filter("component != m.component").select("bucket", *_partner(""))
    third = _untried(known, outside, tried, threshold, everyone=True)
    return tried.union(_verified(third, texts, k, threshold))


def _open_buckets(members: DataFrame, tried: DataFrame) -> DataFrame:
    """``bucket, id, component`` of the buckets whose members are not yet one component."""
    label = components(tried.filter("linked")).withColumnRenamed("node", "id")
    labelled = members.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    labelled = cut(labelled, narrow=True)
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return cut(labelled.join(cut(split.select("bucket"), narrow=True), "bucket", "left_semi"), narrow=True)


_PARTNER = ("id", "n", "u", "total", "mass", "bits", "buckets", "component")


def _partner(of: str) -> list[Column]:
    return [F.col(f"{of}{c}").alias(f"p{c}") for c in _PARTNER]


def _known(open_: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of open buckets with their parts and the array of their buckets."""
    mine = open_.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))  # at most one per band
    return cut(open_.join(parts.join(mine, "id"), "id"), narrow=True)


def _untried(known: DataFrame, partners: DataFrame, tried: DataFrame, threshold: float, everyone: bool) -> DataFrame:
    """Pairs of a bucket's members and partners in other components that may be linked and were not compared.

    With ``everyone``, where all members outside the main component are
    partners, a pair that shares several buckets is looked at in the first.
    """
    partners = cut(partners, narrow=True)
    once = F.array_min(F.array_intersect("buckets", "pbuckets")) == F.col("bucket") if everyone else F.lit(True)
    differ = (F.col("component") != F.col("pcomponent")) & _reachable(threshold)
    pairs = known.join(partners.withColumnRenamed("bucket", "at"), (F.col("bucket") == F.col("at")) & differ & once)
    return pairs.select(*_pairs("id", "pid")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _result(hashed: DataFrame, placed: DataFrame, id_col: str) -> DataFrame:
    out = cut(hashed.select("id").join(placed, "id", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    ), narrow=True)
    sizes = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    sizes = cut(sizes.withColumnRenamed("class_id", "of"), narrow=True)
    one = F.lit(1).cast("long")
    return out.join(sizes, F.col("class_id").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias(id_col), "class_id", F.when(F.col("class_id").isNull(), one).otherwise(F.coalesce("class_size", one)).alias("class_size"),
        "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay (one per class), all columns unchanged.

    Every row is a document of its own here: rows that share an id, or have
    none, are compared and dropped one by one (:func:`row_keys`). The row with
    the smallest id of a class stays, one without an id of its own only where
    no other is.
    """
    keyed = row_keys(docs, id_col)
    gone = near_duplicates(keyed, "__key", text_col, **options).filter("not kept").select(F.col("__key").alias("__gone"))
    return keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti").drop("__key")
