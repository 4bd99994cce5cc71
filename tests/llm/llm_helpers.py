from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = prose(1, 20_000)
    rows = [
        (1, "same  text here", "a", 5, "x"),
        (2, "same text\there", "b", 5, "x"),
        (3, "Same text here", None, None, None),
        (4, None, "a", 1, "y"),
        (5, "", None, 1, "y"),
        (6, " \n ", "b", 1, None),
        (None, "same text here", "a", 1, "y"),
        (None, None, None, None, None),
        (8, long_text, "a", 2, "z"),
        (9, long_text, "b", 2, "z"),
        (9, long_text, "b", 2, "z"),
        (10, "été ☃ password=abcdef12", "a", 2, "z"),
        (11, "-- !!! --", "b", 2, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id long, score string")
