"""op10: code lengths against a plain context tree, held-out accuracy and edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weighbridge.llm import language_id as L
from weighbridge.llm.blocks import blocks

VOCABULARY = {"en": "the of and to in is that for it with".split(), "de": "der die und das nicht für ist von mit über".split(), "fr": "le la et les des une que qui dans été".split()}


def texts(seed, n, names=tuple(VOCABULARY)):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCABULARY[names[i % len(names)]]) for _ in range(rng.randrange(3, 60))), names[i % len(names)]) for i in range(n)]


def plain_tree(samples):
    """Counts of the next byte after every context of up to three bytes."""
    tree = {}
    for text in samples:
        data = b"   " + text.lower().encode()
        for i in range(3, len(data)):
            for depth in range(4):
                tree.setdefault(data[i - depth : i], Counter())[data[i]] += 1
    return tree


def plain_rows(tree, context):
    """Probabilities of all 256 byte values, by the rule of the docstring."""
    shorter = plain_rows(tree, context[1:]) if context else [1 / 256] * 256
    seen = tree.get(context)
    if not seen:
        return shorter
    n, d = sum(seen.values()), len(seen)
    rest = sum(p for b, p in enumerate(shorter) if b not in seen)
    if d == 256:
        return [seen[b] / n for b in range(256)]
    return [seen[b] / (n + d) if b in seen else d / (n + d) * shorter[b] / rest for b in range(256)]


def plain_bits(tree, text):
    data = b"   " + text.lower().encode()
    return sum(-math.log2(plain_rows(tree, data[i - 3 : i])[data[i]]) for i in range(3, len(data)))


def scripts(seed, n):
    """Texts whose bytes have nearly all values that UTF-8 knows."""
    rng = random.Random(seed)
    alphabets = ["abcdefgh ", "абвгд жз", "αβγδε ζ", "あいうえお漢字", "한국어 말", "اللغة ", "עברית ", "हिन्दी ", "ไทย ", "\U0001f600\U00010348 ", "".join(map(chr, range(0x80, 0x800, 5))) + "0123456789!?.,;"]
    return [(i, "".join(rng.choice(alphabets[i % len(alphabets)] + "xy ") for _ in range(rng.randrange(1, 60))), f"l{i % len(alphabets) % 4}") for i in range(n)]


def test_against_a_plain_context_tree(spark):
    taught = scripts(11, 110)
    trees = L.learn(spark.createDataFrame(taught, "doc_id long, text string, lang string"), sample=1000)
    plain = {k: plain_tree([t for _, t, lang in taught if lang == k]) for k in trees.languages}
    assert len({b for _, t, _ in taught for b in t.encode()}) > 112
    asked = [t for _, t, _ in scripts(12, 25)] + ["", "q", "\x00\x7f", "abc"]
    _, _, data, offsets = next(blocks(pa.array([t.lower() for t in asked])))
    got = L.code_lengths(trees, data, offsets)
    for i, text in enumerate(asked):
        assert got[i].tolist() == pytest.approx([plain_bits(plain[k], text) for k in trees.languages], rel=1e-5, abs=1e-4), text
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for r in L.identify(docs, trees).collect():
        if r.lang_pred != "und":
            assert r.lang_pred == trees.languages[got[r.doc_id].argmin()]


def test_rare_contexts_are_left_out_before_the_driver(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_CONTEXTS", 20)
    taught = [(i, t, "x") for i, t, _ in texts(4, 40)]
    trees = L.learn(spark.createDataFrame(taught, "doc_id long, text string, lang string"), sample=1000)
    tree = plain_tree([t for _, t, _ in taught])
    long = sorted((c for c in tree if len(c) == 3), key=lambda c: (-sum(tree[c].values()), c[0] << 16 | c[1] << 8 | c[2]))
    for context in long[20:]:
        del tree[context]
    grams = np.frombuffer(trees.grams[0], np.int64)
    assert len(np.unique(grams[grams < L.CUT] >> 8)) == 20
    asked = [t for _, t, _ in texts(5, 12)]
    _, _, data, offsets = next(blocks(pa.array(asked)))
    assert L.code_lengths(trees, data, offsets)[:, 0].tolist() == pytest.approx([plain_bits(tree, t) for t in asked], rel=1e-5)


def test_rows_are_distributions(spark):
    docs = spark.createDataFrame(texts(1, 60), "doc_id long, text string, lang string")
    trees = L.learn(docs, sample=1000)
    assert trees.languages == ("de", "en", "fr")
    for coder in L.tables(trees)[3]:
        p = 2.0 ** -coder.bits.astype(float)
        weight = np.ones(p.shape[1])
        weight[-1] = 256 - (p.shape[1] - 1)  # the last column stands for all values that were never learned
        assert (p @ weight) == pytest.approx(1, abs=1e-5) and np.all(p > 0)


def test_code_lengths_by_hand(spark):
    docs = spark.createDataFrame([(1, "abab", "x")], "doc_id long, text string, lang string")
    trees = L.learn(docs, sample=10)
    _, _, data, offsets = next(blocks(pa.array(["ab", "aba"])))
    bits = L.code_lengths(trees, data, offsets)[:, 0]
    # contexts: "   "->a, "  a"->b, " ab"->a, "aba"->b, each seen once: n = d = 1, half escapes
    assert bits.tolist() == pytest.approx([2.0, 3.0])
    _, _, data, offsets = next(blocks(pa.array(["aa"])))
    got = L.code_lengths(trees, data, offsets)[0, 0]
    # a; then "  a" escapes (1/2) and rules out b, which leaves " a" and "a" nothing else; the empty
    # context gives a, b and the escape a third each, so a has half of what is left
    assert got == pytest.approx(1 + 1 + 1)


def test_held_out(spark):
    docs = spark.createDataFrame(texts(2, 240), "doc_id long, text string, lang string")
    trees = L.learn(docs.filter("doc_id < 150"), sample=40)
    got = {r.doc_id: r for r in L.identify(docs, trees).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in texts(2, 240) if i >= 150]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark, documents):
    docs = documents((1, None), (2, ""), (3, "123 !?"), (4, "THE OF AND"), (None, "und das"), (5, "the " * 50_000), (4, "THE OF AND"), (6, "中文"))
    trees = L.learn(spark.createDataFrame(texts(3, 90) + [(900, None, "en"), (901, "x", None), (902, "", "en"), (None, "the of", "en")], "doc_id long, text string, lang string"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs, trees).collect()]
    assert sorted(x[:2] for x in got if x[0] in (1, 2, 3)) == [(1, "und"), (2, "und"), (3, "und")]
    assert [x[1] for x in got if x[0] in (4, 5)] == ["en"] * 3 and [x[1] for x in got if x[0] is None] == ["de"]
    assert all(0 <= x[2] <= 1 and not math.isnan(x[2]) for x in got) and len(got) == 8
    nothing = L.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), trees).collect() == []


def test_grams_start_with_blanks():
    _, _, data, offsets = next(blocks(pa.array(["ab", "", "c"])))
    code = L._grams(data, offsets)
    want = [b"   a", b"  ab", b"   c"]
    assert [int(x).to_bytes(4, "big") for x in code] == want
    assert Counter(code.tolist()).most_common(1)[0][1] == 1
