"""Words and their hashes for whole Arrow batches of texts, in numpy, straight from the UTF-8 buffers.

A word class is a table of 256 flags over UTF-8 bytes; bytes from 0x80 are word bytes in both classes used here, so a
word is the same run whether seen as bytes or as characters. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M = np.uint64
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _class(separators) -> np.ndarray:
    flags = np.ones(256, bool)
    flags[list(separators)] = False
    return flags


#: [^\x20\x09-\x0D]+
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = _class([b for b in range(0x80) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_powers = [np.ones(1, M), np.ones(1, M)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> M(30))) * M(0xBF58476D1CE4E5B9)
    x ^= x >> M(27)
    x *= M(0x94D049BB133111EB)
    x ^= x >> M(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, M)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=M)
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: `start` and `end` are byte places in `data`; text i has words first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray):
        self.data = data
        inside = flags[data]
        starts, last = inside.copy(), inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begun = offsets[:-1][offsets[:-1] < offsets[1:]]
            starts[begun] = inside[begun]
            ended = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            last[ended] = inside[ended]
        self.inside = inside
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """64 bits a word."""
        if not len(self.start):
            return np.zeros(0, M)
        up, down = _powers_to(len(self.data))
        each = _VALUES[self.data]
        each *= up[: len(each)]
        each[~self.inside] = 0
        return mix(np.add.reduceat(each, self.start) * down[self.start])

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, lower-cased, with one space between."""
        return b" ".join(LOWER[self.data[self.start[x] : self.end[x]]].tobytes() for x in range(i, j))

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for the k words from each place, len(words) - k + 1 of them, texts' bounds not regarded."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, M)
    out = words[:n] * M(0xD6E8FEB86659FD93)
    for j in range(1, k):
        out += words[j : j + n]
        out *= M(0xD6E8FEB86659FD93)
    return mix(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, flags: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of texts i to j) with about CHUNK_BYTES of text each, never a part of a text."""
    data, offsets = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], flags)
        i = j
