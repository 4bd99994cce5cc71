"""Phrase collocations by Toivonen's sampling method.

A sample of the documents, mined level by level at a lowered threshold,
proposes frequent phrases. One full pass then counts, exactly, every phrase
both of whose parts (all but the last word, all but the first) are proposed:
the proposed phrases and their negative border, which is never enumerated but
recognised where it occurs. A border phrase that turns out frequent is a
failure: a further pass then counts all longer phrases around failures that
were not counted, which closes the set (see :func:`frequent_phrases`).

Tasks recognise proposed phrases by a bit filter of bounded size. A false hit
only makes a pass count a phrase more; every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legation.llm.common import chunks, cut, text_of
from legation.llm.words import buffers, mix

LONGEST = 5  # words of a phrase
SAMPLE = 10  # one document in so many proposes
LOWERED = 1.0  # share of the expected sample count that a proposal needs
FILTER_BITS = (1 << 22, 1 << 28)  # least and most bits of the filter: 0.5 to 32 MB
CHUNK_BYTES = 1 << 20
ROW_BYTES = 2 << 20  # phrase bytes of one output batch
SALTS = 32

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[0x09] = 0x20


def word_hashes(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """A hash of each (language, word)."""
    return mix(pd.util.hash_array(words.astype(object)) + mix(pd.util.hash_array(langs.astype(object))))


def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes of phrases one word longer."""
    return mix(hashes * _STEP + last)


class Filter:
    """A bit filter over phrase hashes, two bits each."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return hashes & _U(bits - 1), (hashes >> _U(32)) & _U(bits - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, len(self.words) * 64):
            out &= (self.words[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)
        return out


def _phrase_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filter words that ``lang, phrase`` rows set: ``word, mask`` rows."""
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            split = [p.split(" ") for p in batch.column(1).to_pylist()]
            sizes = np.array([len(p) for p in split], np.int64)
            hashes = np.zeros(len(split), np.uint64)
            for k in range(sizes.max(initial=0)):
                at = np.flatnonzero(sizes > k)
                word = word_hashes(np.array([split[i][k] for i in at], object), langs[at])
                hashes[at] = word if k == 0 else longer(hashes[at], word)
            at = np.concatenate(Filter.places(hashes, bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["word", "mask"]
            )

    return run


def build_filter(phrases: DataFrame, bits: int, base: Filter | None = None) -> Filter:
    """The filter of ``lang, phrase`` rows, over the bits of ``base``.

    The driver receives one row per set filter word, ``bits`` / 64 at most.
    """
    rows = phrases.select("lang", "phrase").mapInArrow(_phrase_bits(bits), "word long, mask long")
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64) if base is None else base.words.copy()
    words[found["word"].to_numpy()] |= found["mask"].to_numpy().view(np.uint64)
    return Filter(words)


def filter_bits(phrases: int) -> int:
    """Bits of a filter for so many phrases: 32 each, a power of two, within ``FILTER_BITS``."""
    return min(max(1 << (32 * phrases).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


class Words:
    """The words of a batch of texts, lower-cased, by row and piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        data, offsets = buffers(texts)
        kind = _KIND[data]
        if (kind == 1).any():
            # One blank between words: blanks after a blank go, so that a phrase is a slice of the bytes.
            blank = kind == 1
            keep = np.ones(len(data), bool)
            keep[1:] = ~(blank[1:] & blank[:-1])
            if not keep.all():
                kept = np.zeros(len(data) + 1, np.int64)
                np.cumsum(keep, out=kept[1:])
                data, kind, offsets = data[keep], kind[keep], kept[offsets]
        self.flat = _LOWER[data]
        inside = kind == 0
        turn = np.zeros(len(data) + 1, bool)  # where words begin or end
        turn[1:-1] = inside[1:] != inside[:-1]
        if len(data):
            turn[0], turn[-1] = inside[0], inside[-1]
        # A word that runs over a row's end is two.
        border = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        border = np.unique(border[inside[border - 1] & inside[border]])
        marks = np.flatnonzero(turn)
        if len(border):
            marks = np.sort(np.concatenate([marks, border, border]))
        self.starts, self.ends = marks[::2], marks[1::2]
        self.n = len(self.starts)
        row = np.repeat(np.arange(len(langs)), np.diff(np.searchsorted(self.starts, offsets)))
        # The first word of the next piece: a piece ends at a row's end or a mark that ends it.
        cuts = np.sort(np.concatenate([np.flatnonzero(kind == 2), offsets]))
        heads = np.unique(np.append(np.searchsorted(self.starts, cuts), self.n))
        heads = heads if self.n and heads[0] == 0 else np.append(0, heads)
        self.piece_end = np.repeat(heads[1:], np.diff(heads))
        sizes = self.ends - self.starts
        bounds = np.zeros(self.n + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        letters = self.flat[inside]
        column = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(bounds), pa.py_buffer(letters))
        coded = column.dictionary_encode()
        self.words = np.array(coded.dictionary.to_pylist(), object)
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = langs.dictionary_encode()
        self.names = names.dictionary.cast(pa.string())
        self.langs = np.array(self.names.to_pylist(), object)
        self.lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    def runs(self, at: np.ndarray, k: int) -> np.ndarray:
        """Whether the ``k`` words from each place on stand in one piece."""
        return at + k <= self.piece_end[at]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words at these places."""
        return word_hashes(self.words[self.word[at]], self.langs[self.lang[at]])

    def rows(self, first: np.ndarray, k: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``key, n`` rows (:func:`keys`) of the phrases of ``k`` words that begin at ``first``."""
        start, stop = self.starts[first], self.ends[first + k - 1]
        sizes = stop - start
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(ROW_BYTES, sizes.sum() + ROW_BYTES, ROW_BYTES)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            size = sizes[a:b]
            if not len(size):
                continue
            bounds = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=bounds[1:])
            at = np.repeat(start[a:b] - bounds[:-1], size) + np.arange(bounds[-1])
            text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(self.flat[at]))
            yield keys(text.cast(pa.string()), self.names.take(pa.array(self.lang[first[a:b]])), counts[a:b])


def keys(phrases: pa.Array, langs: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """``key, n`` rows; a key is the phrase, which holds no line end, a line end and the language."""
    key = pa.compute.binary_join_element_wise(phrases, langs, "\n")
    return pa.RecordBatch.from_arrays([key, pa.array(counts)], names=["key", "n"])


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense ids of equal codes; the first place and the number of each."""
    ids, found = pd.factorize(codes)
    first = np.empty(len(found), np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    return ids, first, np.bincount(ids, minlength=len(found))


def count_phrases(words: Words, lengths: range, now: Filter | None) -> Iterator[pa.RecordBatch]:
    """Exact counts of the batch's phrases of ``lengths`` both of whose parts ``now`` holds (None: all)."""
    ids, first, counts = grouped(words.lang * len(words.words) + words.word)
    if 1 in lengths:
        yield from words.rows(first, 1, counts)
    hashes = single = words.hashes(first)
    base, word_ids = len(first), ids
    at = np.arange(words.n)  # where the phrases of the level begin, ascending
    for k in range(2, lengths.stop):
        # Places with a known phrase whose next place has one too, in the same piece.
        known = np.ones(len(hashes), bool) if now is None else now.holds(hashes)
        known = known[ids]
        at, ids = at[known], ids[known]
        dense = np.full(words.n + 1, -1, np.int64)
        dense[at] = ids
        both = (dense[at + 1] >= 0) & words.runs(at, k)
        at, ids = at[both], ids[both]
        if not len(at):
            return
        last = word_ids[at + k - 1]
        left, ends = ids, last
        ids, first, counts = grouped(left * base + last)
        hashes = longer(hashes[left[first]], single[ends[first]])
        if k in lengths:
            yield from words.rows(at[first], k, counts)


def count_above(words: Words, longest: int, now: Filter, failed: Filter, frequent: Filter) -> Iterator[pa.RecordBatch]:
    """Exact counts of the batch's phrases around a failure that :func:`count_phrases` with ``now`` left out.

    Phrases with a part that was counted and is not ``frequent`` are passed over.
    """
    ids, first, _ = grouped(words.lang * len(words.words) + words.word)
    single = words.hashes(first)[ids]
    n, level, hit = words.n, single, []
    held = fine = None  # where the full pass counted and knew the phrases of the level before, and where they may be frequent
    for k in range(1, longest + 1):
        if k > 1:
            level = longer(level[: n - k + 1], single[k - 1 :])
        if not len(level):
            return
        inside = words.runs(np.arange(len(level)), k)
        around = np.zeros(len(level), bool)
        for j, places in enumerate(hit, 1):
            for shift in range(k - j + 1):
                around |= places[shift : shift + len(level)]
        counted = inside if k == 1 else inside & held[: len(level)] & held[1 : len(level) + 1]
        if k > 1:
            around &= fine[: len(level)] & fine[1 : len(level) + 1]
        at = np.flatnonzero(around & inside & ~counted)
        if len(at):
            _, first, counts = grouped(level[at].view(np.int64))
            yield from words.rows(at[first], k, counts)
        if k < longest:
            hit.append(failed.holds(level) & inside)
            held = now.holds(level) & counted
            fine = ~counted | frequent.holds(level)


def _counter(lengths: range, now, *above):
    """The task function of a pass; ``now`` and ``above`` are broadcast filter words, ``now`` may be None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *filters = (Filter(f.value) if f is not None else None for f in (now, *above))
        for batch in chunks(batches, "text", CHUNK_BYTES):
            words = Words(batch.column(1), batch.column(0))
            if not words.n:
                continue
            if filters:
                yield from count_above(words, lengths.stop - 1, known, *filters)
                continue
            if 1 in lengths:
                totals = np.bincount(words.lang, minlength=len(words.langs))
                yield keys(pa.array([""] * len(totals)), words.names, totals)
            yield from count_phrases(words, lengths, known)

    return run


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST, sample: int = SAMPLE, lowered: float = LOWERED) -> DataFrame:
    """``lang, phrase, n`` of every phrase up to ``longest`` words that occurs ``least`` times or more.

    ``docs`` has ``id, lang, text`` without nulls in the last two. The empty
    phrase carries the number of words of each language.

    A frequent phrase that the full pass leaves out has a part that was not
    proposed; that part is frequent and, if left out too, has such a part
    itself, down to single words, which are all counted. So every such phrase
    stands around a failure of the full pass, and the expansion pass counts all
    phrases around failures, whatever their length: what it finds is closed.
    """
    context = docs.sparkSession.sparkContext

    def counts(part: DataFrame, needed: int, lengths: range, *filters: Filter | None) -> DataFrame:
        shared = [context.broadcast(f.words) if f is not None else None for f in filters]
        rows = part.select("lang", "text").mapInArrow(_counter(lengths, *shared), "key string, n long")
        sums = rows.groupBy("key").agg(F.sum("n").alias("n")).filter((F.col("n") >= needed) | F.col("key").startswith("\n"))
        phrase = F.substring_index("key", "\n", 1)
        return cut(sums.select(F.substring("key", F.length(phrase) + 2, F.length("key")).alias("lang"), phrase.alias("phrase"), "n"))

    some = docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(sample)) == 0)
    needed = max(1, round(least / sample * lowered))
    proposed = counts(some, needed, range(1, 3), None).filter("phrase <> ''")
    bits = filter_bits(2 * proposed.count())
    now = build_filter(proposed, bits)
    for k in range(3, longest):
        more = counts(some, needed, range(k, k + 1), now)
        now, proposed = build_filter(more, bits, now), proposed.unionByName(more)

    found = counts(docs, least, range(1, longest + 1), now)
    shorter = found.filter("phrase <> ''").filter(F.size(F.split("phrase", " ")) < longest)
    failures = cut(shorter.join(proposed, ["lang", "phrase"], "left_anti"))
    n_failures = failures.count()
    if not n_failures:
        return found
    failed, frequent = build_filter(failures, filter_bits(n_failures)), build_filter(shorter, bits)
    return found.unionByName(counts(docs, least, range(2, longest + 1), now, failed, frequent))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    least: int = 100,
    longest: int = LONGEST,
    top: int = 2000,
    sample: int = SAMPLE,
    lowered: float = LOWERED,
) -> DataFrame:
    """The ``top`` best-scored phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends
    and those into words at blanks and tabs. A phrase of 2 to ``longest`` words
    with ``a >= least`` occurrences scores floor(1000 * a * n / (l * r)) at its
    lowest-scoring cut, the first of equals. Phrases whose words stand in a
    longer phrase that is as frequent are dropped. Ties go to the larger a,
    then to the phrase in byte order. Null text is empty; a null language is
    ``und``. Repeated rows count again. The sample decides how many passes run,
    never the result. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text")
    )
    found = frequent_phrases(source, least, longest, sample, lowered)
    counted = found.filter("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"))
    totals = found.filter("phrase = ''").select("lang", "n")
    phrases = cut(counted.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")))

    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    ends = phrases.filter("k > 2").select(
        "lang", "a", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase")
    )
    covered = ends.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    open_ = phrases.filter("k > 1").join(covered, ["lang", "phrase"], "left").filter("longer_a is null or longer_a < a")

    cuts = open_.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).select(
        "lang", "phrase", "a", "at", part(F.lit(1), F.col("at")).alias("head"), part(F.col("at") + 1, F.col("k") - F.col("at")).alias("tail")
    )
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    # 1000 * a * n / (l * r) in exact decimals; floor by integral division.
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals), "lang")
        .withColumn("above", (F.col("a") * 1000).cast("decimal(20,0)") * wide("n")).withColumn("below", wide("l") * wide("r"))
        .withColumn("score", F.expr("above div below"))
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = best.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = some.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
