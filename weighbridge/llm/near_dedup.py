"""Near duplicates by bottom-k sketches.

One hash function gives every text the set of its word-shingle hashes; the k smallest are its
sketch. Two sets with Jaccard similarity t share about t*k of the k smallest values of their
union, and both sketches hold every shared one, so a count of shared retained values bounds
the similarity: ``least_shared`` is the count that a linked pair misses with a probability
below 1e-7. Sets of at most k values are kept whole and nothing is left to chance.

1. equal sets become one node, so exact copies are never paired;
2. inverted lists of the retained values count the overlaps of nodes. Lists longer than
   ``list_limit`` are left out here: a pair that shares enough values shares some in short
   lists, unless most values of *both* nodes are in long lists;
3. those nodes meet the pivot of each long list (the node with most long-list values, which in
   a group of near copies is the one nearest to all). What pivots do not connect goes through
   an exact prefix filter over the full sets, rarest shingles first, and is compared block by
   block where a list holds nodes of different components; that part alone can grow with the
   square of a group, namely of texts made of passages that many share, yet not similar;
4. the sketch of the union estimates the similarity of each candidate pair;
5. the full sets, made again from both texts, confirm it;
6. links become components by label propagation.

Rows: a null or wordless text has no shingles and is linked with nothing. Rows without id are
left out. Rows that repeat an id count as one document (the one with the smallest set hash).
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import settle
from .blocks import blocks, lists, mix, shingle_sets
from .components import components
from .packed import packed_texts, unpack

SKETCH = 48
LIST_LIMIT = 48
BLOCK_ROWS = 2048


def least_shared(k: int, percent: int, miss: float = 1e-7) -> int:
    """The largest c with P(Binomial(k, percent/100) < c) <= miss, and at least 1."""
    t, below, c = percent / 100, 0.0, 0
    while below + math.comb(k, c) * t**c * (1 - t) ** (k - c) <= miss:
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        c += 1
    return max(c, 1)


def signatures(docs: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, n (set size), fp1, fp2 (hash of the whole set), sketch (its k smallest hashes)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    lists([s[:k].view(np.int64) for s in sets], pa.int64()),
                ], ["doc_id", "n", "fp1", "fp2", "sketch"])

    return docs.mapInArrow(sign, "doc_id long, n long, fp1 long, fp2 long, sketch array<long>")


def _near_in_size(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int, floor: int) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the similarity possible; exact where it holds the whole sets."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.array_intersect("sa", "sb"))

    def rank(x):  # the order of the unsigned hashes
        return x.bitwiseXOR(F.lit(-(2**63)))

    union = F.slice(F.sort_array(F.transform(F.array_union("sa", "sb"), rank)), 1, k)
    shared = F.size(F.array_intersect(union, F.transform("common", rank)))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    exact = 100 * F.size("common") >= percent * (F.col("na") + F.col("nb") - F.size("common"))
    return both.filter(F.when(whole, exact).otherwise(shared * k >= floor * F.size(union))).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar by their full sets."""
    texts = packed_texts(docs)
    # an id that comes with several texts is confirmed by any of them
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("left")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("right")), "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sides, numbers = [], []
                known: dict[bytes, int] = {}
                for name in ("left", "right"):
                    numbers.append([known.setdefault(x, len(known)) for x in part.column(name).to_pylist()])
                for _, _, data, offsets in blocks(pa.array([unpack(x).decode() for x in known], pa.large_string())):
                    sides += shingle_sets(data, offsets, words)
                good = []
                for i, j in zip(*numbers):
                    x, y = sides[i], sides[j]
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * inter >= percent * (len(x) + len(y) - inter))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long").distinct()


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, v) for every shingle."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, [len(s) for s in sets]), pa.int64()),
                    pa.array(np.concatenate(sets).view(np.int64)),
                ], ["node", "v"])

    return docs.mapInArrow(spread, "node long, v long")


def _remaining_links(shingles: DataFrame, nodes: DataFrame, known: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between different components of ``known``, by an exact prefix filter over full sets.

    Nodes that share a prefix element with a node of another component form clusters, which are
    dealt by size of set and in blocks; two blocks at a time are compared in one task, and only
    links that join components leave it.
    """
    shingles = settle(shingles.join(nodes.select("node"), "node"))
    often = shingles.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    # elements in one set only come first; of the others, the rarest
    shared = shingles.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    need = F.expr(f"n - cast(ceil({percent} * n / 100.0) as long) + 1 - (n - size(vs))")
    shared = settle(shared.join(nodes.select("node", "n"), "node").withColumn("take", need.cast("int")).filter("take > 0")
                    .join(known, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), "take", F.col("vs.v").alias("vs")))
    rows = shared.select("node", "component", F.explode(F.expr("slice(vs, 1, take)")).alias("v"))
    # a list of one component needs nothing
    lists_ = rows.groupBy("v").agg(F.min("node").alias("b"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1")
    clusters = components(rows.join(lists_.select("v", "b"), "v").select(F.col("node").alias("a"), "b").distinct())
    step = max(math.log(100 / percent), 0.01) * 1.001  # linked sets are at most one size class apart
    size = F.floor(F.log("n") / step)
    dealt = (shared.join(clusters.withColumnRenamed("component", "cluster"), "node")
             .select("node", "n", "component", "vs", "cluster", F.explode(F.array(size, size + 1)).alias("size")))
    keys = ["cluster", "size"]
    parts = (dealt.groupBy(*keys).agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1")
             .select(*keys, F.ceil(F.col("m") / block_rows).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (dealt.join(parts, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))

    def compare(some: pd.DataFrame) -> pd.DataFrame:
        count, n, part = len(some), some["n"].to_numpy(), some["component"].to_numpy()
        ids = some["node"].to_numpy()
        lengths = [len(v) for v in some["vs"]]
        _, column, often = np.unique(np.concatenate(some["vs"].to_list()), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(count), lengths)
        kept = often[column] > 1
        row, column = row[kept], column[kept]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((count, count), np.float32)
        width = 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, z = np.searchsorted(column, [low, low + width])
            held = np.zeros((count, width), np.float32)
            held[row[a:z], column[a:z] - low] = 1
            common += held @ held.T
        parent = {p: p for p in part.tolist()}

        def root(p):
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        links = []
        for i in range(count):
            j = np.flatnonzero((100 * common[i] >= percent * (n[i] + n - common[i])) & (part != part[i]))
            for k in j[j > i].tolist():
                x, y = root(int(part[i])), root(int(part[k]))
                if x != y:
                    parent[x] = y
                    links.append((ids[i], ids[k]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt.select("node", "n", "component", "vs", *keys, "low", "high").groupBy(*keys, "low", "high").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH, list_limit: int = LIST_LIMIT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per document of ``docs(doc_id, text)``: n_shingles, component_id, kept.

    Documents are linked when their sets of ``words``-word shingles have at least ``percent``
    percent of their union in common; component_id is the smallest doc_id reachable by links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    floor = least_shared(k, percent)
    signed = settle(signatures(docs, words, k))
    one = signed.groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2", "n")).alias("s")).select("doc_id", "s.*")
    one = settle(one.join(one.filter("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("node")), ["fp1", "fp2", "n"], "left"))
    heads = one.filter("doc_id = node").select("node", "fp1", "fp2")
    nodes = settle(signed.withColumnRenamed("doc_id", "node").join(heads, ["node", "fp1", "fp2"])
                   .select("node", "n", "sketch").dropDuplicates(["node"]))

    need = F.least(F.lit(floor), F.ceil(F.col("n") * percent / 100)).cast("int")
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    long_lists = settle(values.groupBy("v").agg(F.count("*").alias("df")).filter(F.col("df") > list_limit))
    in_long = settle(values.join(long_lists, "v").select("node", "n", "v"))
    hot = in_long.groupBy("node").agg(F.count("*").cast("int").alias("h"))
    counted = nodes.select("node", "n", "sketch").join(hot, "node", "left").withColumn("h", F.coalesce("h", F.lit(0))).withColumn("need", need)

    short = counted.select("node", "n", "h", "need", F.explode("sketch").alias("v")).join(long_lists.select("v"), "v", "left_anti")
    x = short.select("v", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "h", "need")])
    y = short.select("v", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "h", "need")])
    overlap = (x.join(y, "v").filter((F.col("node_a") < F.col("node_b")) & _near_in_size("n_a", "n_b", percent))
               .groupBy("node_a", "node_b").agg(F.count("*").alias("o"), F.first("h_a").alias("h_a"), F.first("h_b").alias("h_b"),
                                                F.first("need_a").alias("need_a"), F.first("need_b").alias("need_b")))
    pairs = overlap.filter(F.expr("o + least(h_a, h_b) >= greatest(need_a, need_b)")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    dense = settle(counted.filter("h >= need").select("node", "n", "h"))
    listed = settle(in_long.join(dense, ["node", "n"]))
    pivots = listed.groupBy("v").agg(F.max_by(F.struct("node", "n"), F.struct("h", -F.col("node"))).alias("p"))
    starred = (listed.join(pivots, "v").filter((F.col("node") != F.col("p.node")) & _near_in_size("n", "p.n", percent))
               .select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct())
    candidates = settle(_estimated(pairs.union(starred).distinct(), nodes, k, percent, floor))
    links = settle(_confirmed(candidates, docs, words, percent))

    known = components(links)
    dense_docs = docs.join(dense.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    more = settle(_remaining_links(_full_sets(dense_docs, words).distinct(), dense, known, percent, block_rows))
    if not more.isEmpty():
        known = components(links.union(more))

    found = one.join(known, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))
