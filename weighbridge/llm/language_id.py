"""Language identification by prediction by partial matching.

Every language has a byte context tree of depth 3 with frozen counts. A byte's probability in
its longest known context is count / (n + d), with n bytes and d distinct bytes seen there; a
byte not seen escapes with probability d / (n + d) to the next shorter context, from which the
bytes already ruled out are excluded. Below the empty context every byte value is equally
likely. A text's code length under a language is the sum of -log2 of these probabilities, and
the language with the shortest code wins (ties: the first by name). The score is that language's
share when all languages are equally likely beforehand, 2^-bits over the sum.

Letters are compared in lower case. Learning takes about ``sample`` documents a language, drawn by a
hash of id and text, with whole texts; counts are summed on the executors. The trees, not the
texts, reach the driver: at most ``MAX_CONTEXTS`` contexts of three bytes a language, the most frequent ones,
chosen on the executors, and all shorter ones. All 256 byte values are told apart.
Scoring reads every whole text and needs no shuffle.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing
could be learned. Rows without language, or with a null or empty text, teach nothing. Repeated
rows are each scored. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settle
from .blocks import blocks

DEPTH = 3
SAMPLE = 800
MAX_CONTEXTS = 40_000
CUT = 1 << 32  # marks a gram whose longest context was left out
UNKNOWN = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in one number; a text begins after three spaces."""
    n = len(data)
    padded = np.full(n + DEPTH, 32, np.uint32)
    padded[DEPTH:] = data
    code = padded[DEPTH:].copy()
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, DEPTH + 1):
        before = padded[DEPTH - k : DEPTH - k + n].copy()
        before[place < k] = 32
        code |= before << np.uint32(8 * k)
    return code


@dataclasses.dataclass(frozen=True)
class Trees:
    """Counts of 4-byte grams by language: the leaves of the context trees. Grams with CUT set lack their farthest byte."""

    languages: tuple[str, ...]
    grams: tuple[bytes, ...]
    counts: tuple[bytes, ...]


@dataclasses.dataclass(frozen=True)
class Coder:
    """One language: the row of every shared context, its own byte -> column, and rows of code lengths in bits."""

    index: np.ndarray
    column: np.ndarray
    bits: np.ndarray


@functools.lru_cache(maxsize=1)
def tables(trees: Trees) -> tuple[np.ndarray, int, np.ndarray, list[Coder]]:
    """(byte -> symbol, symbols, pair of nearest symbols -> number, coder of every language).

    Contexts are numbered alike for all languages, by the pair of the two nearest bytes and the third one. A
    byte value that a language never learned has one column for all such values; the weight of that column is their number.
    """
    cut = [np.frombuffer(g, np.int64) >= CUT for g in trees.grams]
    grams = [np.frombuffer(g, np.int64) & (CUT - 1) for g in trees.grams]
    counts = [np.frombuffer(c, np.int64) for c in trees.counts]
    near = [[(g >> (8 * k)) & 255 for k in range(DEPTH + 1)] for g in grams]  # near[j][0] is the byte itself
    values = np.unique(np.concatenate([[32], *[s[k] for s in near for k in (1, 2)], *[s[3][~c] for s, c in zip(near, cut)]]))
    a = len(values) + 1  # the last symbol stands for bytes in no known context
    of = np.full(256, a - 1, np.int64)
    of[values] = np.arange(len(values))
    known_pairs = np.unique(np.concatenate([of[s[1]] + a * of[s[2]] for s in near]))
    pair = np.tile(len(known_pairs) + np.arange(a), a)  # an unknown pair counts as its nearest byte
    pair[known_pairs] = np.arange(len(known_pairs))
    nearest = np.concatenate([known_pairs % a, np.arange(a)])
    coders = []
    for s, c, short in zip(near, counts, cut):
        seen_bytes = np.unique(s[0])
        width = len(seen_bytes) + 1
        column = np.full(256, width - 1, np.int64)
        column[seen_bytes] = np.arange(width - 1)
        weight = np.ones(width)
        weight[-1] = 256 - len(seen_bytes)

        def deeper(rows: np.ndarray, contexts: np.ndarray, among: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(contexts seen, rows with theirs appended); ``parents`` has the row of every shorter context."""
            found, which = np.unique(contexts, return_inverse=True)
            seen = np.bincount(which * width + column[s[0][among]], c[among], len(found) * width).reshape(-1, width)
            return found, np.concatenate([rows, _blend(seen, rows[parents[found]], weight)])

        every = np.ones(len(c), bool)
        rows = _blend(np.bincount(column[s[0]], c, width)[None, :], np.full((1, width), 1 / 256), weight)
        index = np.zeros(a, np.int64)
        for depth, contexts, among in ((1, of[s[1]], every), (2, pair[of[s[1]] + a * of[s[2]]], every), (3, (pair[of[s[1]] + a * of[s[2]]] * a + of[s[3]])[~short], ~short)):
            parents = index if depth == 1 else index[nearest] if depth == 2 else np.repeat(index, a)
            found, more = deeper(rows, contexts, among, parents)
            index = parents.copy()
            index[found] = len(rows) + np.arange(len(found))
            rows = more
        coders.append(Coder(index.astype(np.int32), column.astype(np.int32), (-np.log2(np.maximum(rows, 1e-300))).astype(np.float32)))
    return of.astype(np.int32), a, pair.astype(np.int32), coders


def _blend(seen: np.ndarray, shorter: np.ndarray, weight: np.ndarray) -> np.ndarray:
    n, d = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    left = np.where(seen > 0, 0, shorter)
    rest = (left * weight).sum(1, keepdims=True)
    escape = np.where(rest > 0, d / np.maximum(n + d, 1), 0)
    return np.where(seen > 0, seen * (1 - escape) / np.maximum(n, 1), escape * left / np.where(rest > 0, rest, 1))


def code_lengths(trees: Trees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every row under every language."""
    of, a, pair, coders = tables(trees)
    n = len(data)
    code = of[data]
    place = np.arange(n, dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)

    def before(k: int) -> np.ndarray:
        symbols = np.full(n, of[32], np.int32)
        symbols[k:] = code[: max(n - k, 0)]
        symbols[place < k] = of[32]
        return symbols

    context = pair[before(1) + np.int32(a) * before(2)] * np.int32(a) + before(3)
    bits = np.zeros((len(offsets) - 1, len(coders)))
    for j, coder in enumerate(coders):
        sums = np.zeros(n + 1)
        np.cumsum(coder.bits.ravel()[coder.index[context] * np.int64(coder.bits.shape[1]) + coder.column[data]], dtype=np.float64, out=sums[1:])
        bits[:, j] = sums[offsets[1:]] - sums[offsets[:-1]]
    return bits


def learn(docs: DataFrame, sample: int = SAMPLE) -> Trees:
    """Context trees from ``docs(doc_id, text, lang)``."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and text <> ''")
    shares = [(r.lang, sample / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not shares:
        return Trees((), (), ())
    spark = docs.sparkSession
    limits = spark.createDataFrame(shares, "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language"), "text"), 11) / F.lit(2.0**53)  # 0 to 1 in steps of 2^-53
    some = known.join(F.broadcast(limits), "lang").filter(place < F.col("share")).select("lang", F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in blocks(batch.column("text")):
                grams = _grams(data, offsets)
                which = np.array(names[lo:hi], object)
                sizes = np.diff(offsets)
                for name in sorted(set(names[lo:hi])):
                    found, n = np.unique(grams[np.repeat(which == name, sizes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    summed = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, list] = {}
    for r in _bounded(settle(summed)).collect():
        found.setdefault(r.lang, []).append((r.gram, r.n))
    names = tuple(sorted(found))
    rows = [np.array(sorted(found[k]), np.int64) for k in names]
    return Trees(names, tuple(r[:, 0].copy().tobytes() for r in rows), tuple(r[:, 1].copy().tobytes() for r in rows))


def _bounded(grams: DataFrame) -> DataFrame:
    """``grams`` with the MAX_CONTEXTS most frequent longest contexts a language (ties: the smaller code).

    The counts of the others stay in their two nearest bytes, so shorter contexts lose nothing. Ranked are
    contexts of the drawn texts, not rows of the corpus.
    """
    longest = F.shiftright("gram", 8)
    sums = grams.groupBy("lang", longest.alias("context")).agg(F.sum("n").alias("m"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m"), "context"))
    kept = sums.select("lang", "context", (order > MAX_CONTEXTS).alias("cut"))
    shorter = F.col("gram").bitwiseAND(F.lit((1 << 24) - 1)) + F.lit(CUT)
    marked = grams.withColumn("context", longest).join(kept, ["lang", "context"])
    return marked.groupBy("lang", F.when(F.col("cut"), shorter).otherwise(F.col("gram")).alias("gram")).agg(F.sum("n").alias("n"))


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by SAMPLE and MAX_CONTEXTS

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text"), 1 << 20):
                bits = code_lengths(trees, data, offsets)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("lettered").slice(lo, hi - lo),
                    pa.array([trees.languages[j] for j in best], pa.string()), pa.array(share),
                ], ["doc_id", "lettered", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.lower("text").alias("text"))
    if not trees.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    got = rows.mapInArrow(apply, "doc_id long, lettered boolean, lang_pred string, score double")
    return got.select("doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))
