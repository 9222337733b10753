"""op6: the search against a plain one by dictionary, and exact round trips."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from weighbridge.llm import pieces as P
from weighbridge.llm.blocks import blocks

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="vocabulary file not present")


@pytest.fixture(scope="module")
def loaded():
    return P.load()


@pytest.fixture(scope="module")
def tool(loaded):
    return P.Encoder(loaded)


def encode(tool, texts):
    out = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        ids, rows = tool.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
        back, places = tool.decode(ids, rows)
        assert np.array_equal(places, offsets) and np.array_equal(back, data)
    return out


def plain_search(loaded, text):
    """Viterbi by dictionary over the whole text."""
    if not text:
        return []
    known = {loaded.texts[i]: (i, s) for i, s in zip(loaded.ids, loaded.scores)}
    longest = max(map(len, known))
    unknown = min(loaded.scores) - P.UNKNOWN_PENALTY
    data = b" " + text.encode()
    best = [(0.0, 0, ())] + [None] * len(data)
    for i in range(len(data)):
        if best[i] is None:
            continue
        c = data[i]
        char = 1 if c < 192 else 2 if c < 224 else 3 if c < 240 else 4
        steps = [(j, *known[data[i:j]]) for j in range(i + 1, min(len(data), i + longest) + 1) if data[i:j] in known]
        if not any(j == i + char for j, _, _ in steps):
            steps.append((i + char, None, unknown))
        for j, piece, score in steps:
            if best[j] is None or best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, i, piece)
    out, at = [], len(data)
    while at:
        _, start, piece = best[at]
        out.append([piece] if piece is not None else [loaded.byte_ids[b] for b in data[start:at]])
        at = start
    return [i for part in reversed(out) for i in part]


TEXTS = ["", None, "Hello world", "  two  blanks ", "tab\tand\nline\r\n", "naïve café 😀 中文 ▁ x", "a" * 500, "\x00\x01", "https://example.com/a?b=c", "ÀÉÎ" * 40, "word" * 30 + " é" * 90, "1234567890" * 12, "\n", " "]


def test_against_plain_search(loaded, tool):
    rng = random.Random(2)
    random_texts = ["".join(rng.choice("the an of ing é\nABC 019 ,.") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts = TEXTS + random_texts
    assert encode(tool, texts) == [plain_search(loaded, t or "") for t in texts]


def test_trie():
    words = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    trie = P.Trie(words)
    for k, w in enumerate(words):
        state = 0
        for c in w:
            child = trie.base[state] + c
            assert trie.check[child] == state
            state = child
        assert trie.value[state] == k


def test_rows(spark, documents, loaded):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (2, TEXTS[2])]
    df = documents(*rows)
    got = P.encode(df, loaded)
    assert got.count() == len(rows) and all(r.round_trip for r in got.collect())
    assert sorted(((r.doc_id, r.text) for r in P.decode(got, loaded).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert P.encode(df.limit(0), loaded).collect() == []


def test_long_text(tool, loaded):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(300_000))
    assert len(encode(tool, [text])[0]) > 50_000
