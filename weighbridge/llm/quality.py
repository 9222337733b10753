"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes; only the bag has a label. Each passage is encoded
from its character-class pairs and word repetition, h = tanh(W x + b). Gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the weighted sum of the h gives
the score. Weights are learned from document labels by Adam.

Training takes at most ``sample`` labelled documents, drawn by a hash of the id, with whole
texts, and of these, in drawn order, as many as have ``PASSAGES`` passages together. They are encoded on the
executors and only their features reach the driver (586 bytes a passage, so at most 120 MB). Scoring reads
every passage of every document and needs no shuffle.

Rows: a null or empty text is one passage without characters. Labels are 0 or 1; others, and
labels or documents without id, teach nothing; a document with both labels counts as 0. Without
any usable label every score is 0.5. Repeated rows are scored alike, each on its own; a labelled id with
several rows teaches once, by the text of the smallest hash.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settle
from .blocks import Rolling, blocks, words

PASSAGE_BYTES = 512
SAMPLE = 3000
PASSAGES = 200_000
HIDDEN, GATE = 24, 12
_CLASSES = 17


def _classes() -> np.ndarray:
    kind = np.full(256, 13, np.uint8)  # other bytes below 128
    kind[128:192], kind[192:] = 14, 15
    groups = ((b"aeiouy", 0), (b"bcdfghjklmnpqrstvwxz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3),
              (b" ", 4), (b"\n", 5), (b".", 6), (b",", 7), (b"!?", 8), (b"|\t", 9), (b"#$%&*@", 10), (b"<>{}[]()=/\\_", 11), (b"'\"-;:", 12))
    for group, k in groups:
        kind[list(group)] = k
    return kind


_KIND = _classes()
FEATURES = _CLASSES * _CLASSES + 4


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, number of passages of each row)."""
    sizes = np.diff(offsets)
    parts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.concatenate([[0], np.cumsum(parts)])
    n = int(first[-1])
    inside = np.arange(n) - np.repeat(first[:-1], parts)
    begin = np.repeat(offsets[:-1], parts) + inside * PASSAGE_BYTES
    end = np.minimum(begin + PASSAGE_BYTES, np.repeat(offsets[1:], parts))
    length = end - begin
    of = np.repeat(np.arange(n, dtype=np.int64), length)
    kind = _KIND[data].astype(np.int64)
    previous = np.full(len(data), _CLASSES - 1, np.int64)  # the first byte of a passage follows nothing
    previous[1:] = kind[:-1]
    previous[begin[length > 0]] = _CLASSES - 1
    pairs = np.bincount(of * (_CLASSES * _CLASSES) + previous * _CLASSES + kind, minlength=n * _CLASSES * _CLASSES)
    x = np.zeros((n, FEATURES), np.float32)
    x[:, : _CLASSES * _CLASSES] = np.sqrt(pairs.reshape(n, -1) / np.maximum(length, 1)[:, None])
    starts, ends, _ = words(data, offsets)
    if len(starts):
        where = of[starts]
        word = Rolling(data).at(starts, ends)
        count = np.bincount(where, minlength=n)
        again = np.bincount(where[1:], (word[1:] == word[:-1]) & (where[1:] == where[:-1]), minlength=n)
        key = np.sort((word >> np.uint64(24)) | (where.astype(np.uint64) << np.uint64(40)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
        some = np.maximum(count, 1)
        x[:, -4], x[:, -3], x[:, -2] = again / some, distinct / some, np.log1p(count) / 5
    x[:, -1] = np.log1p(length) / 6
    return x, parts


@dataclasses.dataclass
class Model:
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray, parts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(parts), self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, parts)["p"]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(w: dict, x: np.ndarray, parts: np.ndarray) -> dict:
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), parts))
    a /= np.repeat(np.add.reduceat(a, first), parts)
    z = np.add.reduceat(a[:, None] * h, first)
    return {"first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def _gradients(w: dict, x: np.ndarray, parts: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(w, x, parts)
    dl = (f["p"] - y) / len(y)
    dz = np.repeat(dl[:, None] * w["c"], parts, axis=0)
    toward = (dz * f["h"]).sum(1)
    de = f["a"] * (toward - np.repeat(np.add.reduceat(f["a"] * toward, f["first"]), parts))
    dt = de[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ dl, "d": np.array(dl.sum())}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Learn from bags of passage features; the same input gives the same model."""
    if len(bags) == 0 or labels.min() == labels.max():
        return Model({}, np.zeros(FEATURES), np.ones(FEATURES), 0.5 if len(bags) == 0 else float(labels[0]))
    rng = np.random.default_rng(11)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    w = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
         "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.array(0.0)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = (np.concatenate([bags[i] for i in some]) - mean) / scale
            grads = _gradients(w, x, np.array([len(bags[i]) for i in some]), labels[some].astype(float))
            step += 1
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    share = sample / max(known.count(), 1)
    pick = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    some = known.withColumn("pick", pick).filter(F.col("pick") < F.lit(int(2 * share * (1 << 20)) + 64)).orderBy("pick", "doc_id").limit(sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                x, parts = passages(data, offsets)
                at = np.concatenate([[0], np.cumsum(parts)])
                rows = [x[a:b].astype(np.float16).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    # at most ``sample`` rows of a few numbers: these sides are small by the limit
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("name")).join(F.broadcast(some), "doc_id")
    parts = F.greatest(F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE_BYTES), F.lit(1))
    once = found.groupBy("doc_id", "pick").agg(F.min(F.struct("name", parts.alias("parts"))).alias("row")).select("doc_id", "pick", "row.name", "row.parts")
    upto = F.sum("parts").over(Window.orderBy("pick", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = settle(once.withColumn("upto", upto).filter(F.col("upto") <= PASSAGES).select("doc_id", "name"))
    taught = found.join(F.broadcast(chosen), ["doc_id", "name"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted(taught.mapInArrow(encode, "doc_id long, label int, x binary").collect(), key=lambda r: (r.doc_id, r.x))
    bags = [np.frombuffer(r.x, np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                got = model.scores(*passages(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.clip(got, 0, 1).astype(float))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        found = [model.scores(*passages(data, offsets)) for _, _, data, offsets in blocks(text)]
        return pa.array(np.concatenate(found).astype(float) if found else np.zeros(0))

    return docs.filter(scored("text") >= threshold)
