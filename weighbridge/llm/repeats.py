"""Repeated substrings, by longest-previous-factor arrays cut at ``length`` bytes.

In suffix order, suffixes that share their first ``length`` bytes are neighbours. Within such a run the
previous and next smaller positions of a suffix are its earlier matches: every suffix but the
first (by doc_id, position) has a longest previous factor of ``length`` or more, and is a later copy.
Only whether LPF >= length matters here, so instead of sorting all suffixes of the corpus the
runs are found by names (128-bit hashes of substrings; equal names, equal bytes), from coarse to fine:

1. each window of ``length`` bytes belongs to an anchor, its smallest hash of a gram of about a third
   of the length. Equal windows have equal anchors, and neighbouring windows share one, so there is
   one row for some 130 bytes. Only anchors whose gram occurs twice go on;
2. an anchor's windows together are its context. Members of a class of equal contexts are copies
   as a whole; one of them stands for the class from here on;
3. of anchors with differing contexts, cells of 16 neighbouring windows are compared: by the bytes
   common to all windows of the cell (no other like it: no copies), and by all bytes of the cell
   (another like it: copies as a whole);
4. windows of the remaining cells, those at the ends of repeated passages, are compared one by one.

Counts and minima combine before each shuffle, so a passage in a third of all documents costs a
row per map task, and no task holds a whole class. Text is shuffled compressed, once for the
contexts and once to cut the spans.

Rows: text is its UTF-8 bytes; a null text has none. Rows without doc_id are places of their own
and come first in order. Rows that repeat an id and text are two places with one position: each is
a repeat of the other, and with ``keep_first`` both stay. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import settle
from .blocks import Rolling, blocks, mix
from .packed import pack, unpack

LENGTH = 400
CELL = 16
_PLACE = np.uint64((1 << 31) - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    tiles = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, place, first start, last start, gram hash, context hash) of a block's anchors."""
    window = max(1, length * 16 // 25)
    gram = length - window + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    one = Rolling(data)
    keys = one.every(gram) & ~_PLACE
    keys |= np.arange(len(keys), dtype=np.uint64)
    place = (_least(keys, window) & _PLACE).astype(np.int64)
    del keys
    starts = np.arange(len(place))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = starts + length <= offsets[row + 1]
    starts, place, row = starts[inside], place[inside], row[inside]
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    row, place, low, high = row[new], place[new], starts[new], starts[last]
    context = Rolling(data, 1).at(low, high + length)
    context = mix(context + (place - low).astype(np.uint64) * np.uint64(0x9E3779B1) + (high - low).astype(np.uint64))
    return row, place, low, high, one.at(place, place + gram), context


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for lo, _, data, offsets in blocks(batch.column("text")):
                row, place, low, high, gram, context = anchors(data, offsets, length)
                begin = offsets[row]
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), tags.take(at), pa.array((place - begin).astype(np.int32)), pa.array((low - begin).astype(np.int32)),
                    pa.array((high - begin).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)),
                ], ["doc_id", "tag", "place", "low", "high", "g", "h"])

    return docs.select("doc_id", "tag", "text").mapInArrow(scan, "doc_id long, tag binary, place int, low int, high int, g long, h long")


def _classes(rows: DataFrame, outer: str, inner: str, at: str) -> DataFrame:
    """(outer, inner, n, first, kinds): classes of equal (outer, inner), where outer occurs twice.

    ``first`` is the first place of the class, ``kinds`` the number of classes of its outer name.
    """
    inside = rows.groupBy(outer, inner).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", at)).alias("first"))
    outside = inside.groupBy(outer).agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter(F.col("all") > 1).drop("all")
    return inside.join(outside, outer)


def _is_first(at: str) -> Column:
    return F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"first.{at}") == F.col(at))


def _copies(keep_first: bool, at: str) -> Column:
    """Whether a member of a class is to be removed."""
    return (F.col("n") > 1) & (~_is_first(at) if keep_first else F.lit(True))


def _tag() -> Column:
    """A 128-bit name of the text: rows without doc_id are known by it alone."""
    return F.unhex(F.md5("text")).alias("tag")


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag (tells texts of one id, or without id, apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag(), "text").filter("text is not null")


def _packed(docs: DataFrame) -> DataFrame:
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"),
                                                  pa.array([pack((x or "").encode()) for x in part.column("text").to_pylist()], pa.binary())], ["doc_id", "tag", "packed"])

    return docs.mapInArrow(shrink, "doc_id long, tag binary, packed binary")


def _contexts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The chosen anchors with the bytes of their contexts."""
    of = chosen.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("place", "low", "high")).alias("anchors"))
    texts = _packed(docs)
    both = texts.join(of, texts.doc_id.eqNullSafe(of.doc_id) & (texts.tag == of.tag)).select(texts.doc_id, texts.tag, "packed", "anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpack(batch.column("packed")[i].as_py())
                found = sorted((a["place"], a["low"], a["high"]) for a in batch.column("anchors")[i].as_py())
                place, low, high = (np.array(x, np.int32) for x in zip(*found))
                same = pa.array(np.zeros(len(found), np.int64) + i)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(same), batch.column("tag").take(same), pa.array(place), pa.array(low), pa.array(high),
                    pa.array([text[a : z + length] for a, z in zip(low.tolist(), high.tolist())], pa.binary()),
                ], ["doc_id", "tag", "place", "low", "high", "bytes"])

    return both.mapInArrow(cut, "doc_id long, tag binary, place int, low int, high int, bytes binary")


def _block(contexts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contexts one after another and where each begins."""
    values = contexts.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])])


_PART = 2048


def _cells(contexts: DataFrame, length: int) -> DataFrame:
    """Per cell of windows: its place, starts, name of the common core and of all its bytes."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                part = batch.slice(at, _PART)
                data, begin = _block(part.column("bytes"))
                place, low, high = (part.column(c).to_numpy().astype(np.int64) for c in ("place", "low", "high"))
                first, last = (place - high) // CELL, (place - low) // CELL
                many = last - first + 1
                i = np.repeat(np.arange(len(many)), many)
                cell = first[i] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                # windows start at place - offset, offsets from CELL * cell to CELL * cell + CELL - 1
                start, stop = np.maximum(place[i] - CELL * cell - CELL + 1, low[i]), np.minimum(place[i] - CELL * cell, high[i])
                shift = begin[i] - low[i]
                core = Rolling(data).at(place[i] - CELL * cell + shift, place[i] - CELL * cell - CELL + 1 + length + shift)
                outer = mix(core + cell.astype(np.uint64) * np.uint64(0x9E3779B1))
                inner = Rolling(data, 1).at(start + shift, stop + length + shift)
                inner = mix(inner + (place[i] - start).astype(np.uint64) * np.uint64(0x85EBCA6B) + (stop - start).astype(np.uint64))
                rows = pa.array(i)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(rows), part.column("tag").take(rows), part.column("place").take(rows),
                    pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(outer.view(np.int64)), pa.array(inner.view(np.int64)),
                ], ["doc_id", "tag", "place", "start", "stop", "g", "h"])

    return contexts.mapInArrow(name, "doc_id long, tag binary, place int, start int, stop int, g long, h long")


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """Every window of the cells listed with each context, with two names."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                part = batch.slice(at, _PART)
                data, begin = _block(part.column("bytes"))
                low = part.column("low").to_numpy().astype(np.int64)
                i, start = [], []
                for k, cells in enumerate(part.column("cells").to_pylist()):
                    for c in cells:
                        i += [k] * (c["stop"] - c["start"] + 1)
                        start += range(c["start"], c["stop"] + 1)
                i, start = np.array(i, np.int64), np.array(start, np.int64)
                a = begin[i] + start - low[i]
                rows = pa.array(i)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(rows), part.column("tag").take(rows), pa.array(start.astype(np.int32)),
                    pa.array(Rolling(data).at(a, a + length).view(np.int64)), pa.array(Rolling(data, 1).at(a, a + length).view(np.int64)),
                ], ["doc_id", "tag", "start", "g", "h"])

    return contexts.mapInArrow(name, "doc_id long, tag binary, start int, g long, h long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """(doc_id, tag, spans): byte ranges [a, z) of the repeats in each text that has some."""
    tagged = _tagged(docs)
    rows = settle(_anchor_rows(tagged, length))
    classes = settle(_classes(rows, "g", "h", "place"))
    shared = settle(rows.join(classes, ["g", "h"]).select(
        "doc_id", "tag", "place", "low", "high", _copies(keep_first, "place").alias("copy"), ((F.col("kinds") > 1) & _is_first("place")).alias("open")))
    spans = [shared.filter("copy").select("doc_id", "tag", F.col("low").alias("a"), (F.col("high") + length).alias("z"))]

    contexts = settle(_contexts(tagged, shared.filter("open"), length))
    cells = settle(_cells(contexts, length))
    shared = settle(cells.join(_classes(cells, "g", "h", "start"), ["g", "h"]).select(
        "doc_id", "tag", "place", "start", "stop", _copies(keep_first, "start").alias("copy"), ((F.col("kinds") > 1) & _is_first("start")).alias("open")))
    spans.append(shared.filter("copy").select("doc_id", "tag", F.col("start").alias("a"), (F.col("stop") + length).alias("z")))

    key = ["doc_id", "tag", "place"]
    listed = shared.filter("open").groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("cells"))
    on = contexts.doc_id.eqNullSafe(listed.doc_id) & (contexts.tag == listed.tag) & (contexts.place == listed.place)
    windows = settle(_windows(contexts.join(listed, on).select(contexts.doc_id, contexts.tag, "low", "bytes", "cells"), length))
    twice = windows.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).filter("n > 1")
    found = windows.join(twice, ["g", "h"]).filter(_copies(keep_first, "start"))
    spans.append(found.select("doc_id", "tag", F.col("start").alias("a"), (F.col("start") + length).alias("z")))
    every = spans[0].union(spans[1]).union(spans[2])
    return every.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "z")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjacent spans."""
    runs: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in (spans if spans is not None else ())):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    return [(a, z) for a, z in runs]


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0] + [z for _, z in runs]
    begins = [a for a, _ in runs] + [len(data)]
    return b"".join(data[z:a] for z, a in zip(ends, begins))


def removal_report(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    ``text`` is what is left, without characters that lost some of their bytes.
    """
    spans = settle(repeated_spans(docs, length, keep_first))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag(), F.coalesce("text", F.lit("")).alias("text"))
    texts = _packed(ids)
    both = texts.join(spans, texts.doc_id.eqNullSafe(spans.doc_id) & (texts.tag == spans.tag), "left").select(texts.doc_id, "packed", "spans")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column("packed"), batch.column("spans")):
                data, runs = unpack(packed.as_py()), merged(spans.as_py())
                left = kept(data, runs)
                rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            if rows:
                size, removed, n, sha, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(text)],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return both.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; a character that loses some of its bytes goes whole."""
    spans = settle(repeated_spans(docs, length, keep_first))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([kept(t.encode(), merged(s)).decode("utf-8", "ignore") if t is not None and s is not None and len(s) else t for t, s in zip(text, spans)])

    side = spans.select(F.col("doc_id").alias("_span_id"), F.col("tag").alias("_span_tag"), F.col("spans").alias("_spans"))
    on = F.col("doc_id").eqNullSafe(F.col("_span_id")) & (_tag() == F.col("_span_tag"))
    both = docs.join(side, on, "left")
    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut("text", "_spans"))
    return both.select(*[new.alias(c) if c == "text" else F.col(c) for c in docs.columns])
