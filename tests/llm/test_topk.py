"""op8: against scoring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm.topk import Lists, top_k

OUT = ["query_id", "rank", "vec_id", "score"]


def brute_force(rows, k, step=20):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and (i not in own or v < own[i]):
            own[i] = v
    out = []
    for q in sorted(i for i in own if i % step == 0):
        scored = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def run(spark, rows, k, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, v array<long>, rank int, shard int")
    got = top_k(df, F.col("vec_id") % 20 == 0, k, **options)
    assert got.columns == OUT
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dims,shard,block", [(3, 50, 4), (1, 1000, 1000), (16, 100, 3), (2, 7, 1)])
def test_against_all_pairs(spark, dims, shard, block):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.integers(-9, 9, dims).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # one very common vector
    assert run(spark, rows, 20, shard_rows=shard, block_rows=block) == brute_force(rows, 20)


def test_edge_rows(spark):
    rows = [(0, [1, 2]), (20, [0, 0]), (40, None), (60, [1, None]), (1, [3, -1]), (2, [1, 2, 3]), (80, [1, 1, 1]), (3, [0, 0]), (None, [5, 5]),
            (4, [2**40, 2**20]), (0, [1, 2]), (5, [7, 7]), (5, [6, 6]), (100, []), (6, []), (120, [9] * 5)]
    assert run(spark, rows, 20) == brute_force(rows, 20)
    assert run(spark, rows, 2) == brute_force(rows, 2)
    assert top_k(spark.createDataFrame([], "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0).collect() == []


def test_stops_early_on_skewed_lists():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, (5000, 4))
    values[:30] += 1000
    lists = Lists(np.arange(5000), values)
    got = lists.top(np.array([1, 2, 1, 3]), -1, 10)
    assert got is not None
    scores = values @ np.array([1, 2, 1, 3])
    want = np.lexsort((np.arange(5000), -scores))[:10]
    assert got[0].tolist() == want.tolist()
