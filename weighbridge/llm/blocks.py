"""Texts of an Arrow batch as byte arrays, and hashes of their substrings.

Everything here works on one batch inside a task. A block holds whole texts of about
``limit`` bytes; one longer text is a block of its own, so a task needs some 60 bytes of
memory per byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: white space of the word rule: space and the bytes 9 to 13
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


class Rolling:
    """Hash of any substring of a block in constant time (polynomial modulo 2^64)."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.n = len(data)
        self.inverse = _up_to(self.n + 1)[1]
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_CODES[which][data] * _powers[0][: self.n], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of this width, by start."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:m]) * self.inverse[:m])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and where each row's words begin among them."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``size`` words, A-Z in lower case.

    A row with fewer words has one shingle, the whole sequence; a row without words none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    word = Rolling(data).at(starts, ends)
    count = len(word)
    total = np.zeros(max(count - size + 1, 0), np.uint64)
    for j in range(size):
        total += mix(word[j : count - size + 1 + j] + np.uint64(j * 0x51ED270B)) * np.uint64(2 * j + 0x2545F491)
    total = mix(total)
    sets = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            sets.append(np.unique(total[lo : hi - size + 1]))
        elif hi > lo:
            short = np.uint64(hi - lo)
            for j in range(lo, hi):
                short = mix(np.array([short ^ word[j]], np.uint64) + np.uint64(j - lo + 1))[0]
            sets.append(np.array([short], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
