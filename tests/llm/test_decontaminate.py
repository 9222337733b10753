"""op2: items found in texts against an alignment over the whole text."""

import random

import numpy as np
import pytest

from weighbridge.llm.decontaminate import Items, align, budget, contaminated, find, remove_contaminated


def fold(text):
    out = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return bytes(32 if b in (9, 10, 11, 12, 13) else b for b in out)


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute_force(docs, items, q, percent):
    out = {}
    for d, text in docs:
        for i, item in items:
            item = fold(item).strip()
            if d is None or text is None or len(item) < q:
                continue
            edits = least_edits(item, fold(text))
            if edits <= budget(len(item), q, percent):
                out[d, i] = edits
    return out


def noisy(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        p = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[p] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(p, rng.choice("xyz"))
        else:
            del chars[p]
    return "".join(chars)


@pytest.mark.parametrize("seed,q,percent", [(1, 6, 10), (2, 8, 8), (3, 12, 6)])
def test_against_alignment(spark, seed, q, percent):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    items = [(i, text(rng.choice([20, 60, 110, 150]))) for i in range(12)]
    docs = []
    for d in range(40):
        parts = [text(rng.randrange(60))]
        if rng.random() < 0.7:
            parts += [noisy(rng, rng.choice(items)[1], rng.randrange(14)), text(rng.randrange(60))]
        docs.append((d, "".join(parts)))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), q, percent)
    best = {}
    for r in got.collect():
        best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
        region = fold(dict(docs)[r.doc_id])[r.start_byte : r.end_byte]
        assert least_edits(fold(dict(items)[r.item_id]).strip(), region) <= r.edits
    assert best == brute_force(docs, items, q, percent)


def test_align():
    item, text = b"abcdefghij", b"zzabcdxefghijzz"
    assert align(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), 5, 2) == (1, 2, 13)
    assert align(np.frombuffer(item, np.uint8), np.frombuffer(b"qqqqqqqqqqqq", np.uint8), 5, 2) is None


def test_edge_rows(spark, documents):
    item = "The quick brown fox jumps over the lazy dog again and again"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "tiny"), (None, item), (5, "é" * 40)], "item_id long, text string")
    docs = documents((1, "xx " + item.upper().replace(" ", "\n") + " yy"), (2, None), (3, ""), (None, item), (4, item[:30]), (5, "a" * 300_000 + item), (6, "é" * 50), (1, item))
    got = {(r.doc_id, r.item_id, r.start_byte, r.end_byte, r.edits) for r in contaminated(docs, bench).collect()}
    m = len(item)
    assert {(1, 1, 3, 3 + m, 0), (1, 1, 0, m, 0), (5, 1, 300_000, 300_000 + m, 0)} <= got
    assert {(r[0], r[1]) for r in got} == {(1, 1), (5, 1), (6, 5)}
    left = remove_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "None"]


def test_small_blocks_find_the_same(spark, documents):
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcdefghijk ") for _ in range(80))) for i in range(20)]
    docs = documents(*[(i, "pre " + t + " post") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in contaminated(docs, bench).collect()}
    assert one == {tuple(r) for r in contaminated(docs, bench, block_bytes=300).collect()} and len(one) >= 20


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(documents((1, "x" * 50)), bench).collect() == []
    assert contaminated(documents().limit(0), spark.createDataFrame([(1, "some item text here")], "item_id long, text string")).collect() == []


def test_repeated_letters_do_not_overflow():
    items = Items((1,), (b"a" * 60,), 12, 6)
    data = np.frombuffer(b"a" * 5000, np.uint8)
    assert find(items, data, np.array([0, 5000]))
