"""op1: near duplicates against all pairs."""

import random
import re

import pytest

from weighbridge.llm.components import components
from weighbridge.llm.near_dedup import least_shared, near_duplicates

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1)))


def brute_force(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed):
    """Groups of near copies with edits, passages shared by many, exact copies and loners."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice("xyzuvw") + rng.choice("xyzuvw")
    text = lambda n: [word() for _ in range(n)]
    rows, at = [], 100
    shared = text(40)
    for group in range(4):
        base = text(rng.choice([60, 150, 300]))
        for _ in range(rng.choice([3, 30, 70])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((at, " ".join(copy)))
            at += 1
    for _ in range(70):
        rows.append((at, " ".join(shared + text(rng.choice([2, 8, 15, 60])))))
        at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size,percent,limit,block", [(1, 5, 80, 48, 2048), (2, 4, 80, 5, 2048), (3, 5, 90, 10, 9), (4, 3, 70, 4, 6)])
def test_against_all_pairs(documents, seed, size, percent, limit, block):
    rows = corpus(seed)
    got = result(near_duplicates(documents(*rows), words=size, percent=percent, list_limit=limit, block_rows=block))
    assert got == brute_force(rows, size, percent)


def test_edge_rows(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A b"), (8, "b a"),
            (9, "w " * 5000), (10, "w " * 4000), (None, "one"), (11, "É x y z"), (12, "é x y z"), (5, "one")]
    got = result(near_duplicates(documents(*rows), words=4))
    want = brute_force([r for r in rows if r[0] is not None], 4, 80)
    assert got == want
    assert got[5] == (1, 4, False) and got[1] == (0, 1, True)


def test_one_row_per_repeated_id(documents):
    got = near_duplicates(documents((3, "a b c d e f"), (3, "x y z u v w"), (4, "a b c d e f")))
    assert sorted(r.doc_id for r in got.collect()) == [3, 4]


def test_empty_table(documents):
    df = near_duplicates(documents().limit(0))
    assert df.collect() == [] and df.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[95] == 90


def test_least_shared():
    assert 20 <= least_shared(48, 80) <= 26
    assert least_shared(10, 100) == 10


def test_query(spark, sf):
    from weighbridge.llm.catalogue import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op1_near_dedup"](spark, sf)) == brute_force(rows, 4, 80)
