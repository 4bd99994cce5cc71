"""Benchmark decontamination by pigeonhole edit matching.

An occurrence of an item with at most k edits leaves at least one of any
k + 1 pieces of the item untouched. All pieces of all items form one
Aho-Corasick automaton; every exact piece hit in a document names a window,
and Myers' bit-parallel distance decides whether the item occurs there.

Pieces are the leaves of a tree whose nodes are runs of neighbouring pieces. A
run of m pieces with m edits or more cannot be avoided by both halves of a run
within its budget, so some untouched piece has only ancestors of m pieces with
m - 1 edits at most: hits are tested up the tree, and chance hits of short
pieces end at their first ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, row_keys, text_of


def folded(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of ``budget + 1`` consecutive pieces of nearly equal length."""
    cuts = [length * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    """Per character, the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, char in enumerate(pattern):
        out[char] = out.get(char, 0) | 1 << i
    return out


def myers(where: dict[str, int], length: int, text: str, anchored: bool = False) -> list[int]:
    """Edit distance of the pattern to the best substring ending at each place of ``text``.

    With ``anchored`` substrings start at the beginning of ``text``.
    """
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score, out = full, 0, length, []
    for char in text:
        eq = where.get(char, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        if anchored:
            plus |= 1
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        out.append(score)
    return out


def occurs(where: dict[str, int], length: int, text: str, budget: int) -> bool:
    """Whether some substring of ``text`` is within ``budget`` edits of the pattern; ends when that is certain."""
    if length <= budget:
        return True
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    # A character lowers the score by one at most; spare is how many more need not.
    spare = len(text) + budget - length
    for eq in map(where.get, text, repeat(0)):
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if minus & high:
            score -= 1
            if score <= budget:
                return True
        else:
            if plus & high:
                score += 1
                spare -= 1
            spare -= 1
            if spare < 0:
                return False
        plus = (plus << 1) & full
        up = ((minus << 1) & full) | (full & ~(diagonal | plus))
        down = plus & diagonal
    return False


def ancestors(leaves: int) -> list[list[tuple[int, int]]]:
    """Per leaf, the runs (first leaf, end leaf) that hold it, smallest first, without the run of all leaves."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(leaves)]
    runs = [(i, i + 1) for i in range(leaves)]
    while len(runs) > 3:
        # Neighbours in twos; the last three are one run where their number is odd.
        cuts = [*range(0, len(runs) - len(runs) % 2, 2)]
        runs = [(runs[i][0], runs[len(runs) - 1 if i == cuts[-1] else i + 1][1]) for i in cuts]
        for run in runs:
            for leaf in range(*run):
                out[leaf].append(run)
    return out


def neighbour(text: str, cuts: list[tuple[int, int]], leaf: int, runs: list[tuple[int, int]]) -> tuple[str, int, str, int]:
    """What must stand beside a piece whose smallest run is of two pieces: ``near, near_at, far, far_at``.

    That run has one edit at most, so one half of the neighbour is whole: the
    near one in its place, or the far one within one character of its place.
    Places count from the start of the piece. Empty texts ask for nothing.
    """
    if not runs or runs[0][1] - runs[0][0] != 2:
        return "", 0, "", 0
    other = runs[0][0] if leaf != runs[0][0] else runs[0][0] + 1
    (a, b), start = cuts[other], cuts[leaf][0]
    half = (a + b) // 2
    low, high = (text[a:half], a - start), (text[half:b], half - start)
    return (*high, *low) if other < leaf else (*low, *high)


def surroundings(text: str, cuts: list[tuple[int, int]], leaf: int, runs: list[tuple[int, int]], known: bool) -> list[tuple]:
    """The larger runs around a piece, ``start, end, budget, signs`` each.

    ``signs`` are slices of what the run has beyond the run before, one more
    than its budget: one of them stands whole, moved by no more than the
    budget. Each is given as ``slice, low, high``, the characters to look in.
    """
    out, inner = [], runs[0] if known else (leaf, leaf + 1)
    for run in runs[known:]:
        budget = run[1] - run[0] - 1
        sides = [(cuts[run[0]][0], cuts[inner[0]][0]), (cuts[inner[1] - 1][1], cuts[run[1] - 1][1])]
        (a, b) = max(sides, key=lambda side: side[1] - side[0])
        signs = tuple((text[a + i : a + j], a + i - budget, a + j + budget) for i, j in pieces(b - a, budget))
        out.append((cuts[run[0]][0], cuts[run[1] - 1][1], budget, signs))
        inner = run
    return out


class Matcher:
    """Finds every occurrence of the items within their edit budgets.

    An item of n characters has a budget of ``int(n * rate)`` edits.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        self.parts: dict[tuple[int, int, int], dict[str, int]] = {}
        self.margin = 0  # characters that a neighbour can lie before its piece
        hits: dict[str, list[tuple]] = {}
        for item_id, text in items:
            if not text:
                continue
            budget = int(len(text) * rate)
            index = len(self.items)
            self.items.append((item_id, text, budget, masks(text), masks(text[::-1])))
            cuts = pieces(len(text), budget)
            for leaf, runs in enumerate(ancestors(len(cuts))):
                near, near_at, far, far_at = neighbour(text, cuts, leaf, runs)
                self.margin = max(self.margin, 1 - far_at)
                larger = surroundings(text, cuts, leaf, runs, bool(near or far))
                place = (near, near_at, far, far_at - 1, far_at + 1 + len(far), index, cuts[leaf][0], larger)
                hits.setdefault(text[slice(*cuts[leaf])], []).append(place)
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, start, end, places) of the best occurrence of each item found."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        margin = self.margin
        padded = "\0" * margin + text  # so that places before the text need no test
        beside, found_in = padded.startswith, padded.find
        for end, (size, places) in self.automaton.iter(text):
            at = end + 1 - size
            base = at + margin
            for near, near_at, far, far_low, far_high, index, offset, larger in places:
                if not beside(near, base + near_at) and found_in(far, base + far_low, base + far_high) < 0:
                    continue
                guesses = starts.get(index)
                # All untouched pieces of an occurrence give one start; its runs are tested once.
                if guesses and at - offset in guesses:
                    continue
                if self._grows(index, at - offset, larger, text):
                    starts.setdefault(index, set()).add(at - offset)
        out = []
        for index, guesses in starts.items():
            found = self._verify(index, sorted(guesses), text)
            if found:
                out.append((self.items[index][0], *found))
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, m[2]))

    def _grows(self, index: int, base: int, larger: list[tuple], text: str) -> bool:
        """Whether every run occurs where it must within its budget, for an item that begins at ``base``."""
        find = text.find
        for start, end, budget, signs in larger:
            for sign, low, high in signs:
                low += base
                if find(sign, low if low > 0 else 0, max(0, base + high)) >= 0:
                    break
            else:
                return False
            where = self.parts.get((index, start, end))
            if where is None:  # the masks of a run are made when first needed
                where = self.parts[index, start, end] = masks(self.items[index][1][start:end])
            if not occurs(where, end - start, text[max(0, base + start - budget) : max(0, base + end + budget)], budget):
                return False
        return True

    def _verify(self, index: int, guesses: list[int], text: str) -> tuple[int, int, int, int] | None:
        _, item, budget, forward, backward = self.items[index]
        length = len(item)
        best, places, i = None, 0, 0
        while i < len(guesses):
            low = high = guesses[i]
            while i < len(guesses) and guesses[i] <= high + 2 * budget:  # windows that touch are one
                high = guesses[i]
                i += 1
            if low == high and low >= 0 and text.startswith(item, low):
                found = (0, low, low + length)
            else:
                base = max(0, low - budget)
                window = text[base : high + length + budget]
                scores = myers(forward, length, window)
                distance = min(scores)
                if distance > budget:
                    continue
                end = scores.index(distance) + 1
                # Read backwards from the end, the longest prefix of that distance gives the start.
                back = myers(backward, length, window[:end][::-1][: length + budget], anchored=True)
                start = end - 1 - max(n for n, score in enumerate(back) if score == distance)
                found = (distance, base + start, base + end)
            places += 1
            if best is None or found < best:
                best = found
        return (*best, places) if best else None


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_chars`` characters (one item at least)."""
    block, size = [], 0
    for item_id, text in items.select(F.col(id_col).cast("long"), text_of(text_col)).toLocalIterator():
        text = folded(text)
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


_OUT = "doc long, item long, distance long, start long, end long, places long"


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = 0.14,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per document and item found in it: ``<id>, item_id, distance, start, end, n_places``.

    An item occurs where a substring of the document is within
    ``int(error_rate * length)`` edits of it, both compared in lower case with
    white space folded; ``start`` and ``end`` (exclusive) are the characters
    of the best occurrence in the folded text (least distance, then first) and
    ``n_places`` counts the separate windows with an occurrence.

    Items are held in blocks of ``block_chars`` characters; each block is one
    scan of the documents, so a benchmark of any size is matched against all
    rows. Null or blank items never match, null or empty documents contain
    none, rows and items without an id are scanned and reported with a null
    id. Equal items are reported under each id, and
    repeated (document, item) rows once each per input row.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in chunks(batches, "text"):
                rows: list[list] = [[] for _ in range(6)]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for match in matcher.matches(folded(text.as_py())):
                        for column, value in zip(rows, (doc, *match)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in rows], names=["doc", "item", "distance", "start", "end", "places"]
                )

        return source.mapInArrow(run, _OUT)

    found = [scan(block) for block in _item_blocks(items, item_id_col, item_text_col, block_chars)] or [scan([])]
    return reduce(DataFrame.union, found).select(
        F.col("doc").alias(id_col), F.col("item").alias("item_id"), "distance", "start", "end", F.col("places").alias("n_places")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without any benchmark match, all columns unchanged.

    Every row is judged by its own text: rows without an id go if their text
    matches, and a clean row stays though a row with its id goes.
    """
    keyed = row_keys(docs, id_col)
    hit = benchmark_matches(keyed, items, "__key", text_col, **options).select(F.col("__key").alias("__hit")).distinct()
    return keyed.join(hit, F.col("__key") == F.col("__hit"), "left_anti").drop("__key")
