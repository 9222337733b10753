"""op3: gradients, held-out accuracy and edge rows."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from weighbridge.llm import quality
from weighbridge.llm.blocks import blocks

import pyarrow as pa


def labelled(n, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 400))]
        bad = rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else words[:20] + [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_gradients():
    rng = np.random.default_rng(0)
    old = quality.FEATURES
    w = {"W": rng.normal(size=(old, 5)) * 0.1, "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)),
         "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.array(0.3)}
    x, parts, y = rng.normal(size=(7, old)), np.array([1, 4, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(quality._forward(w, x, parts)["p"]) + (1 - y) * np.log(1 - quality._forward(w, x, parts)["p"]))
    grads = quality._gradients(w, x, parts, y)
    for k in w:
        flat, g = w[k].reshape(-1), grads[k].reshape(-1)
        for j in (0, len(flat) // 2, len(flat) - 1):
            keep = flat[j]
            flat[j] = keep + 1e-6
            up = loss()
            flat[j] = keep - 1e-6
            down = loss()
            flat[j] = keep
            assert abs((up - down) / 2e-6 - g[j]) < 1e-5, k


def test_passages_of_whole_texts():
    texts = pa.array(["", None, "a" * 512, "a" * 513, "é" * 600])
    _, _, data, offsets = next(blocks(texts))
    x, parts = quality.passages(data, offsets)
    assert parts.tolist() == [1, 1, 1, 2, 3] and x.shape == (8, quality.FEATURES) and np.isfinite(x).all()


def test_held_out_accuracy(spark):
    rows, labels = labelled(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, marks.filter("doc_id < 450"), sample=300)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    right = sum((got[i] >= 0.3) == bool(y) for i, y in labels if i >= 450)
    assert right / 150 > 0.95


def test_edge_rows(spark, documents):
    docs = documents((1, None), (2, ""), (3, "x" * 100_000), (None, "text"), (3, "x" * 100_000))
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    marks = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    model = quality.train(docs, marks)
    scores = quality.score(docs, model).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    kept = quality.keep_good(docs, none, 0.3)
    assert kept.count() == 5 and kept.columns == docs.columns
    assert quality.score(docs.limit(0), model).collect() == [] and quality.keep_good(docs.limit(0), model, 0.3).collect() == []
    assert quality.train(docs, marks.filter("quality = 1 and doc_id = 1")).constant == 1.0


def test_query(spark, sf):
    from weighbridge.llm.catalogue import QUERIES

    got = QUERIES["op3_quality"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and rows.a > 0.8


def plain_score(model, text):
    """The docstring's rule passage by passage, without arrays over all passages."""
    data = (text or "").encode()
    starts = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    gates, states = [], []
    for at in range(0, max(len(data), 1), quality.PASSAGE_BYTES):
        part = data[at : at + quality.PASSAGE_BYTES]
        x = np.zeros(quality.FEATURES)
        before = quality._CLASSES - 1
        for byte in part:
            x[before * quality._CLASSES + int(quality._KIND[byte])] += 1
            before = int(quality._KIND[byte])
        x[:-4] = np.sqrt(x[:-4] / max(len(part), 1))
        here = [w for s, w in starts if at <= s < at + quality.PASSAGE_BYTES]
        x[-4] = sum(a == b for a, b in zip(here, here[1:])) / max(len(here), 1)
        x[-3], x[-2], x[-1] = len(set(here)) / max(len(here), 1), math.log1p(len(here)) / 5, math.log1p(len(part)) / 6
        w = model.weights
        h = np.tanh(((x - model.mean) / model.scale) @ w["W"] + w["b"])
        gates.append(float(w["w"] @ (np.tanh(w["V"].T @ h) / (1 + np.exp(-(w["U"].T @ h))))))
        states.append(h)
    share = np.exp(np.array(gates) - max(gates))
    z = sum(a * h for a, h in zip(share / share.sum(), states))
    return 1 / (1 + math.exp(-(z @ model.weights["c"] + model.weights["d"])))


def test_scores_against_a_plain_forward_pass(spark):
    docs, labels = labelled(160)
    model = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    asked = [(i, t) for i, t in docs[:30]] + [(900, None), (901, ""), (902, "  \n "), (903, "ab " * 900 + "?" * 700), (904, "é漢 word word\tword"), (905, "x" * 1024)]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        assert abs(got[i] - plain_score(model, text)) < 1e-4, (i, text)


def test_training_is_bounded(spark, monkeypatch):
    docs, labels = labelled(60)
    bags = []
    monkeypatch.setattr(quality, "fit", lambda x, y: bags.append([len(b) for b in x]))
    hot = docs + [(docs[0][0], docs[0][1])] * 300 + [(docs[0][0], f"other text {i}") for i in range(300)] + [(docs[1][0], None)]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (docs, hot)]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    for frame in frames:
        quality.train(frame, known)
    assert len(bags[0]) == len(bags[1]) == len({i for i, _ in labels})
    monkeypatch.setattr(quality, "PASSAGES", sum(bags[0]) // 2)
    quality.train(frames[0], known)
    assert 0 < sum(bags[2]) <= sum(bags[0]) // 2
