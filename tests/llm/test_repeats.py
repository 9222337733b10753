"""op4: repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import pytest

from weighbridge.llm.repeats import removal_report, remove_repeats


def letters(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghé") for _ in range(n))


def brute_force(rows, length, keep_first):
    places = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    data = [(t or "").encode() for _, t in rows]
    for k in order:
        for s in range(len(data[k]) - length + 1):
            places.setdefault(data[k][s : s + length], []).append((k, s))
    gone = [bytearray(len(d)) for d in data]
    for found in places.values():
        for k, s in found[1:] if keep_first else found if len(found) > 1 else []:
            gone[k][s : s + length] = b"\x01" * length
    out = []
    for (i, _), d, g in zip(rows, data, gone):
        left = bytes(c for c, x in zip(d, g) if not x)
        spans = sum(1 for p in range(len(g)) if g[p] and (p == 0 or not g[p - 1]))
        out.append((i, len(d), sum(g), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [text(rng.choice([39, 40, 41, 60, 100, 300])) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [text(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts += [p[a:] if rng.random() < 0.3 else p, text(rng.randrange(0, 60))]
        rows.append((i * 3 % 80, "".join(parts)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "ab" * 300), (203, "a" * 250), (204, text(3000))]
    return rows


@pytest.mark.parametrize("seed,length,keep_first", [(1, 40, False), (2, 40, True), (3, 64, False), (4, 25, True)])
def test_against_all_windows(documents, seed, length, keep_first):
    rows = corpus(seed)
    assert result(removal_report(documents(*rows), length, keep_first)) == brute_force(rows, length, keep_first)


def test_edge_rows(documents):
    long = letters(5, 200_000).replace("é", "i")
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, long[1000:90_000]), (6, "x" * 400), (7, "y" * 399)]
    got = {r[0]: r for r in result(removal_report(documents(*rows), 400, False))}
    assert got[1][1:4] == (0, 0, 0) and got[4][1:4] == (200_000, 89_000, 1) and got[5][1:4] == (89_000, 89_000, 1)
    assert got[6][2] == 0 and got[7][2] == 0


def test_repeated_rows_and_missing_ids(documents):
    text = letters(6, 500).replace("é", "i")
    other = letters(7, 500).replace("é", "i")
    rows = [(1, text), (1, text), (1, other), (None, other), (2, None)]
    got = result(removal_report(documents(*rows), 400, False))
    assert [r[2] for r in got if r[0] != 2] == [500] * 4
    # with keep_first, a repeated row is at the first place as well; the row without id comes first
    kept = {(r[0], r[1], r[2]) for r in result(removal_report(documents(*rows), 400, True))}
    assert kept == {(1, 500, 0), (1, 500, 500), (None, 500, 0), (2, 0, 0)}


def test_texts_keep_their_columns(documents):
    text = letters(8, 600)
    df = documents((1, text), (2, "start " + text + " end"), (3, None), (4, "é"))
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert got[1].text == text and got[2].text == "start  end" and got[3].text is None and got[4].text == "é"
    assert got[2].spans == [3] and remove_repeats(df).columns == df.columns


def test_empty_table(documents):
    assert removal_report(documents().limit(0)).collect() == []
    assert remove_repeats(documents().limit(0)).collect() == []


def test_query(spark, sf):
    from weighbridge.llm.catalogue import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op4_suffix_dedup"](spark, sf)) == brute_force(rows, 400, False)


def test_rows_without_id_are_told_apart_by_their_whole_text(spark):
    """Two texts of one 32-bit hash: the one that is unique stays whole."""
    from weighbridge.llm.repeats import removal_report

    shared, unique = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300)), "".join(chr(97 + i * 5 % 26) + str(i * i) for i in range(150))
    rows = [(None, shared), (1, shared), (None, unique), (None, "short")]
    got = removal_report(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False).collect()
    assert sorted(((r.n_bytes, r.n_removed, r.text) for r in got)) == sorted([(len(shared), len(shared), "")] * 2 + [(len(unique), 0, unique), (5, 0, "short")])


def test_many_equal_rows_cost_in_proportion(spark):
    from weighbridge.llm.repeats import _anchor_rows, _classes, _contexts, _is_first, _tagged
    from pyspark.sql import functions as F

    text = "".join(f"{i * i} word {i}, " for i in range(300))
    sizes = []
    for copies in (10, 40):
        docs = spark.createDataFrame([(None, text)] * copies + [(None, "other " + text)], "doc_id long, text string")
        tagged = _tagged(docs)
        rows = _anchor_rows(tagged, 400)
        chosen = rows.join(_classes(rows, "g", "h", "place"), ["g", "h"]).filter((F.col("kinds") >= 1) & _is_first("place"))
        sizes.append(_contexts(tagged, chosen, 400).count())
    assert sizes[1] <= 4.2 * sizes[0]
