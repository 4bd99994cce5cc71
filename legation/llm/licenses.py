"""License scans: identifier tags and notice phrases, and licence expressions.

Texts are folded to words (digits, ASCII letters in lower case, non-ASCII
characters). One Aho-Corasick automaton over the folded text finds notice
phrases and identifier tags at word boundaries; the expression after a tag is
parsed by the shunting-yard algorithm (WITH binds tighter than AND, AND than
OR) and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, text_of
from legation.llm.words import IS_WORD

# Phrases and labels of the base scan.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices of well-known licences.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How freely text under a label may be reused, 0 to 1; other labels count OTHER.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc0": 1.0, "isc": 1.0, "unlicense": 1.0, "cc-by": 0.9, "mpl-2": 0.7,
    "cc-by-sa": 0.6, "lgpl": 0.5, "gpl-2": 0.3, "gpl-3": 0.3, "agpl": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0,
}
OTHER, EXCEPTION_GAIN = 0.4, 0.2
# Identifier prefixes of tags and the label each belongs to; the longest prefix wins.
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache-2", "bsd": "bsd", "cc0": "cc0", "isc": "isc", "unlicense": "unlicense",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "mpl-2": "mpl-2", "lgpl": "lgpl",
    "gpl-2": "gpl-2", "gpl-3": "gpl-3", "agpl": "agpl",
}

_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if IS_WORD[b] else 0x20 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    name = identifier.lower()
    prefixes = [p for p in IDENTIFIERS if name == p or name.startswith((p + "-", p + ".", p + "+"))]
    return IDENTIFIERS[max(prefixes, key=len)] if prefixes else name


def evaluate(expression: str) -> tuple[float, set[str]] | None:
    """(freedom, labels) of a licence expression, None if it is not one.

    OR takes the freer side, AND the less free one; WITH adds the exception's
    gain to its licence. Shunting-yard: operators wait on a stack until one
    that binds less (or a closing bracket) applies them to the values.
    """
    values: list[tuple[float, set[str]]] = []
    waiting: list[str] = []
    want_value = True

    def apply() -> None:
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            values.append((min(1.0, left[0] + EXCEPTION_GAIN), left[1]))
        else:
            pick = max if op == "or" else min
            few, many = sorted((left[1], right[1]), key=len)
            many |= few  # in place: a long chain of licences stays linear
            values.append((pick(left[0], right[0]), many))

    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word == "(" and want_value:
            waiting.append(word)
        elif word == ")" and not want_value:
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                return None
            waiting.pop()
        elif word in _BINDS and not want_value:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                apply()
            waiting.append(word)
            want_value = True
        elif word not in _BINDS and word not in "()" and want_value:
            label = label_of(token)
            values.append((FREEDOM.get(label, OTHER), {label}))
            want_value = False
        elif not want_value:
            break  # words after a whole expression are comment
        else:
            return None
    if want_value or "(" in waiting:
        return None
    while waiting:
        apply()
    return values[0]


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *notices, TAG}:
            # Folded texts have one space at each end and between words.
            self.automaton.add_word(f" {phrase} ", (phrase, base.get(phrase), notices.get(phrase)))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """(words, base places, first, last, base labels, labels, score, expressions)."""
        words = text.encode("utf-8", "replace").translate(_FOLD).split()
        folded = (b" " + b" ".join(words) + b" ").decode("latin-1")
        places, base_labels, labels, freedom, tagged = [], set(), set(), [], False
        at = before = 0  # spaces before a place, counted on from the last match
        for end, (phrase, base, notice) in self.automaton.iter(folded):
            if phrase == TAG:
                tagged = True
            if base is not None:
                start = end - len(phrase)
                before += folded.count(" ", at, start) - folded.count(" ", start, at)
                at = start
                places.append(before - 1)
                base_labels.add(base)
            label = base if base is not None else notice
            if label is not None:
                labels.add(label)
                freedom.append(FREEDOM.get(label, OTHER))
        expressions = 0
        for found in _EXPRESSION.finditer(text) if tagged else ():
            result = evaluate(found[1])
            if result:
                expressions += 1
                freedom.append(result[0])
                labels |= result[1]
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(freedom, default=0.0), expressions,
        )


_COLUMNS = (
    ("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"),
    ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"), ("n_expressions", pa.int64(), "long"),
)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """One row per document: ``<id>, n_words, n_base, first_word, last_word, base_labels, labels, score, n_expressions``.

    ``n_base`` counts the places where the words of a base phrase stand
    consecutively; ``first_word`` and ``last_word`` are the smallest and
    largest start among them. ``labels`` adds notices and tag expressions.
    ``score`` is the freedom of the least free licence found (a tag counts
    with its expression's value), 0 without any. Null and empty texts have no
    words; ids may be null or repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in chunks(batches, "text"):
            columns = zip(*(scanner.scan(text.as_py()) for text in batch.column(1)))
            arrays = [pa.array(values, kind) for values, (_, kind, _) in zip(columns, _COLUMNS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *(c[0] for c in _COLUMNS)])

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = ", ".join(["id long", *(f"{name} {kind}" for name, _, kind in _COLUMNS)])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
