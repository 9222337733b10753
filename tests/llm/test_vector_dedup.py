import numpy as np
import pytest

from tests.helpers import row_set
from weighbridge.llm.vector_dedup import agreement, most_bits_apart, near_duplicates, passes

DDL = "vec_id long, embedding array<float>, node string, ball int, copies string, label int"


def vectors(spark, *rows):
    """Rows (vec_id, embedding) beside columns with the operator's own names."""
    return spark.createDataFrame([(i, v, "n", 1, "c", 2) for i, v in rows], DDL)


def brute(rows, least=0.9):
    seen = {}
    for i, v in rows:
        if i is not None:
            good = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
            seen[i] = np.array(v, np.float32).astype(float) if good else None
    ids = sorted(seen)
    links = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            x, y = seen[i], seen[j]
            if i != j and x is not None and y is not None and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i].add(j)
    low = {i: i for i in ids}
    for _ in ids:
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in ids}
    return sorted([(i, len(links[i]), low[i], low[i] == i) for i in ids], key=repr)


def clusters(seed, sizes, dims=32, spread=0.1):
    """Groups of near copies of the given sizes, in mixed order; none reaches 0.9 with another."""
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            jitter = rng.standard_normal(dims)
            out.append(centre + spread * jitter / np.linalg.norm(jitter))
    order = rng.permutation(len(out))
    return [(int(k), [float(x) for x in out[at]]) for k, at in enumerate(order)]


def test_equals_all_pairs_on_groups_of_any_size(spark):
    rows = clusters(1, [1] * 60 + [2] * 20 + [3, 5, 17, 120])
    assert row_set(near_duplicates(vectors(spark, *rows))) == brute(rows)


def test_group_far_larger_than_the_window(spark):
    from weighbridge.llm.vector_dedup import near_vectors

    rows = clusters(2, [1] * 100 + [2] * 10 + [300])
    table = vectors(spark, *rows).selectExpr("vec_id", "embedding AS v").repartition(7)
    assert row_set(near_vectors(table, window=8)) == brute(rows)


def test_chains_of_links_and_wider_groups(spark):
    rng = np.random.default_rng(5)
    plane = rng.standard_normal((2, 16))
    plane[0] /= np.linalg.norm(plane[0])
    plane[1] -= plane[0] * (plane[0] @ plane[1])
    plane[1] /= np.linalg.norm(plane[1])
    turn = [(k, [float(x) for x in np.cos(k * 0.3) * plane[0] + np.sin(k * 0.3) * plane[1]]) for k in range(8)]
    assert row_set(near_duplicates(vectors(spark, *turn))) == brute(turn)
    wide = clusters(6, [40, 1, 2], dims=16, spread=0.3)
    assert row_set(near_duplicates(vectors(spark, *wide))) == brute(wide)


def test_copies_and_repeated_rows(spark):
    copies = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(900, [2.0, 4.0, 6.0]), (901, [3.0, -2.0, 0.5])]
    got = {r.vec_id: r for r in near_duplicates(vectors(spark, *copies, copies[0], copies[7])).collect()}
    assert len(got) == 502
    assert got[7].n_links == 500 and got[7].component_id == 0 and not got[7].kept and got[0].kept
    assert got[900].n_links == 500 and got[901].n_links == 0 and got[901].kept


def test_nulls_zeros_lengths_and_empty(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1e-30, 0.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e30, 1e28]), (-4, [-1.0, 0.0])]
    assert row_set(near_duplicates(vectors(spark, *rows))) == brute(rows)
    assert near_duplicates(vectors(spark, *rows).limit(0)).count() == 0
    assert row_set(near_duplicates(vectors(spark, (3, None)))) == [(3, 0, 3, True)]


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_passes_leave_few_pairs_unfound(cosine):
    assert 0 < agreement(cosine) < 1
    assert passes(100, cosine) == 1 < passes(10**5, cosine) < passes(10**8, cosine)
    assert most_bits_apart(cosine) < 64


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 48))
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = 0.902 * x + np.sqrt(1 - 0.902**2) * y
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(np.concatenate([x, pairs]))]
    from weighbridge.llm.vector_dedup import near_vectors

    got = near_vectors(vectors(spark, *rows).selectExpr("vec_id", "embedding AS v"), window=64)
    assert got.filter("n_links > 0").count() >= 0.98 * 3000
    assert got.filter("vec_id < 1500 and component_id != vec_id").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_copies_of_a_salted_table_are_not_broadcast(spark, how):
    from weighbridge.llm.vector_dedup import _salted_join
    from weighbridge.sources import settle

    rows = settle(spark.createDataFrame([(i % 3, i) for i in range(60)], "ball long, node long"))
    table = settle(spark.createDataFrame([(0, "a"), (1, "b")], "ball long, name string"))
    joined = _salted_join(rows, table, "ball", "node", how)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = [(i % 3, i, "abc"[i % 3] if i % 3 < 2 else None) for i in range(60) if how == "left" or i % 3 < 2]
    assert row_set(joined.select("ball", "node", "name")) == sorted(want, key=repr)
