"""Words, word hashes and shingles of Arrow text batches, computed with numpy.

A word is a run of digits, ASCII letters (A-Z count as a-z) and non-ASCII
characters; every other ASCII character separates words. In UTF-8 every byte
of a non-ASCII character is 0x80 or more, so the rule holds byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += _U(32)
_VALUE = mix(_LOWER * _BASE + _U(1))

# Words are hashed from blocks of so many bytes, so that what is held for a text does not grow with it.
BLOCK = 1 << 18


def _powers(base: np.uint64) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < BLOCK."""
    table = np.full(BLOCK, base, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


_POWER, _INVERSE_POWER = _powers(_BASE), _powers(_INVERSE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string array; nulls are empty."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, width, count=n + 1, offset=texts.offset * width().itemsize) if offsets and n else np.zeros(n + 1, width)
    raw = np.frombuffer(data, np.uint8) if data and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's first word (n + 1 bounds)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = IS_WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _long_word(data: np.ndarray) -> np.ndarray:
    """The sum of one word of more than a block."""
    total = 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += int((_VALUE[part] * _POWER[: len(part)]).sum()) * pow(int(_BASE), at, 1 << 64)
    return np.array([total % (1 << 64)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every (lower-cased) word, and each text's first word (n + 1 bounds)."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        until = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))  # the words of a block, or one longer word
        own = data[low : ends[until - 1]]
        if len(own) > BLOCK:
            total = _long_word(own)
        else:
            begin, end = starts[at:until] - low, ends[at:until] - low
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_VALUE[own] * _POWER[: len(own)], out=sums[1:])
            total = (sums[end] - sums[begin]) * _INVERSE_POWER[begin]
        out[at:until] = mix(total + _U(7))
        at = until
    return out, first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one text; a shorter text is one shingle, no words none."""
    if len(words) == 0:
        return words
    span = min(k, len(words))
    out = np.zeros(len(words) - span + 1, np.uint64)
    for j in range(span):
        out = out * _BASE + words[j : j + len(out)]
    return mix(out + _U(span))
