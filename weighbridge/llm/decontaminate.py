"""Benchmark decontamination with the q-gram lemma.

Benchmark items and documents are compared as UTF-8 bytes in ASCII lower case, white space of any
kind as a blank. An item of m bytes is found in a document when a region lies within
k = min(m * edit_percent / 100, m / q - 1) edits of it (rounded down). Such a region shares at least
m + 1 - q (k + 1) q-grams with the item (the q-gram lemma), and all of them lie on diagonals
(place in the text - place in the item) that differ by at most k. So

1. every q-gram of every text is looked up among the items' q-grams;
2. shared ones are counted per item in diagonal bands of width 2w, each overlapping the next by w > k;
3. bands that reach the bound are regions to verify: equal text is seen at once, the rest by a
   banded alignment whose ends are free in the text.

The benchmark is taken in blocks of about ``block_bytes`` of item text, so what is broadcast has a
bound however large the benchmark is; each block is one pass over the documents, without shuffle.

Rows: a null or empty item, or one of fewer than q bytes, is never found; a null text holds nothing.
Repeated items or documents give one row per pair of ids and region. Items or documents without id
are left out. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, Rolling, blocks

Q = 12
EDIT_PERCENT = 6
BLOCK_BYTES = 1 << 22
_BITS = 22
_FOLD = LOWER.copy()
_FOLD[SPACE] = 32


def budget(m: int, q: int = Q, edit_percent: int = EDIT_PERCENT) -> int:
    return max(0, min(m * edit_percent // 100, m // q - 1))


@dataclasses.dataclass(frozen=True)
class Items:
    ids: tuple[int, ...]
    texts: tuple[bytes, ...]
    q: int
    edit_percent: int


@functools.lru_cache(maxsize=1)
def index(items: Items):
    """Sorted q-gram hashes, the (item, place) entries of each, and a bit filter over the hashes."""
    hashes, owner, place = [], [], []
    for i, text in enumerate(items.texts):
        h = Rolling(np.frombuffer(text, np.uint8)).every(items.q)
        hashes.append(h)
        owner.append(np.full(len(h), i))
        place.append(np.arange(len(h)))
    hashes, owner, place = (np.concatenate(x) for x in (hashes, owner, place))
    order = np.argsort(hashes, kind="stable")
    known, first = np.unique(hashes[order], return_index=True)
    maybe = np.zeros(1 << _BITS, bool)
    maybe[known >> np.uint64(64 - _BITS)] = True
    return known, np.append(first, len(order)), owner[order], place[order], maybe


def align(item: np.ndarray, region: np.ndarray, shift: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole item in ``region``, or None above k edits.

    Only cells on diagonals from -shift - k to shift + k around the main one are filled. Among equal
    edits the match with the earliest end wins, and of its alignments the one that starts last.
    """
    m, n = len(item), len(region)
    low, width = -shift - k, 2 * (shift + k) + 1
    far = m + n + 1
    columns = np.arange(width) + low
    cost = np.where((columns >= 0) & (columns <= n), 0, far)
    start = columns.copy()
    step = np.arange(width)
    for i in range(1, m + 1):
        j = columns + i
        inside = (j >= 0) & (j <= n)
        letter = region[np.clip(j - 1, 0, max(n - 1, 0))] if n else np.zeros(width, np.uint8)
        match = np.where(j >= 1, cost + (letter != item[i - 1]), far)
        gap = np.append(cost[1:], far) + 1
        from_gap = gap < match
        best = np.where(inside, np.where(from_gap, gap, match), far)
        origin = np.where(from_gap, np.append(start[1:], 0), start)
        # a run of text letters without partner: the least of best[x] + (y - x) over x <= y
        lead = np.minimum.accumulate((best - step) * width + (width - 1 - step))
        source = width - 1 - lead % width
        cost = np.where(inside, best[source] + step - source, far)
        start = origin[source]
    end = int(np.argmin(cost))
    if cost[end] > k:
        return None
    return int(cost[end]), int(start[end]), int(columns[end] + m)


def find(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of every region found in a block of texts."""
    q = items.q
    known, first, owner, place, maybe = index(items)
    text = _FOLD[data]
    grams = Rolling(text).every(q)
    at = np.flatnonzero(maybe[grams >> np.uint64(64 - _BITS)])
    slot = np.searchsorted(known, grams[at])
    hit = slot < len(known)
    hit[hit] = known[slot[hit]] == grams[at][hit]
    at, slot = at[hit], slot[hit]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + q <= offsets[row + 1]
    at, slot, row = at[inside], slot[inside], row[inside]
    many = first[slot + 1] - first[slot]
    entry = np.repeat(first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, row = owner[entry], np.repeat(row, many)
    diagonal = np.repeat(at, many) - place[entry]
    length = np.array([len(t) for t in items.texts])
    edits = np.array([budget(len(t), q, items.edit_percent) for t in items.texts])
    bound = np.maximum(length + 1 - q * (edits + 1), 1)
    reach = int(length.max())
    band = (diagonal + reach) // (edits[item] + 1)
    # band b holds the diagonals of cells b and b + 1, so any k + 1 neighbouring ones share a band
    cell = np.stack([row, item, band])
    key = np.concatenate([cell, cell - np.array([[0], [0], [1]])], axis=1)
    if key.shape[1] == 0:
        return []
    order = np.lexsort(key[::-1])
    key = key[:, order]
    new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
    count = np.diff(np.append(new, key.shape[1]))
    key = key[:, new]
    found: dict[tuple[int, int, int, int], int] = {}
    for r, i, b in key[:, count >= bound[key[1]]].T.tolist():
        m, k = int(length[i]), int(edits[i])
        pattern = np.frombuffer(items.texts[i], np.uint8)
        head = b * (k + 1) - reach  # the first diagonal of the band
        lo, hi = max(int(offsets[r]), head - k), min(int(offsets[r + 1]), head + 2 * (k + 1) + m + k)
        exact = text[lo:hi].tobytes().find(items.texts[i])
        if exact >= 0:
            found[r, i, lo + exact, lo + exact + m] = 0
            continue
        got = align(pattern, text[lo:hi], hi - lo - m if hi - lo > m else k, k)
        if got:
            found.setdefault((r, i, lo + got[1], lo + got[2]), got[0])
    return [(r, i, a - int(offsets[r]), z - int(offsets[r]), e) for (r, i, a, z), e in sorted(found.items())]


def item_blocks(benchmark: DataFrame, q: int, edit_percent: int, block_bytes: int) -> Iterator[Items]:
    """The items to search for, a bounded number of bytes at a time."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / block_bytes))
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect() if total else []
        folded = sorted((r.item_id, _FOLD[np.frombuffer(r.text.encode(), np.uint8)].tobytes().strip()) for r in some)
        folded = [x for x in dict.fromkeys(folded) if len(x[1]) >= q]
        if folded:
            yield Items(tuple(i for i, _ in folded), tuple(t for _, t in folded), q, edit_percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_percent: int = EDIT_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Regions of ``docs(doc_id, text)`` that match items of ``benchmark(item_id, text)``.

    doc_id, item_id, start_byte, end_byte (in the UTF-8 text), edits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, start_byte long, end_byte long, edits int"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, q, edit_percent, block_bytes):
        found = found.union(_searched(docs, items, schema))
    return found.distinct()


def _searched(docs: DataFrame, items: Items, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in blocks(batch.column("text")):
                rows = find(items, data, offsets)
                if rows:
                    r, i, a, z, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[lo + np.array(r)], pa.int64()), pa.array([items.ids[x] for x in i], pa.int64()),
                        pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(e, pa.int32()),
                    ], ["doc_id", "item_id", "start_byte", "end_byte", "edits"])

    return docs.mapInArrow(search, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no item is found, with all their columns; rows without id stay."""
    dirty = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)
