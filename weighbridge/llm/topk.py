"""Exact top-k by inner product with Fagin's threshold algorithm.

Rows are dealt by a hash of the id into shards of about ``shard_rows`` candidates and blocks of
about ``block_rows`` queries; a task takes one shard and one block. In the shard each dimension is
a list sorted by value, read from the end that the query's sign asks for. Reading goes down
all lists together; every row met is scored from its whole vector, and the value of the query
at the lists' current depth bounds every row not met yet. A query stops when that bound is
below its k-th score: equal scores must still be read, as the smaller id wins. With many dense
dimensions the bound falls late, so after ``DEPTHS`` the queries still open take the lists to their
end, all rows at once. The k best of each shard then meet per query.

Vectors that are null, or hold a null or a non-finite component, take no part; vectors of
different length never meet. A vec_id that comes with several vectors counts with the smallest
one; rows without id take no part. Products are exact as long as they fit a 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, BLOCK_ROWS = 16384, 1024
DEPTHS = (16, 64)
_OUT = "query_id long, vec_id long, score long"


class Lists:
    """The sorted lists of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.up = np.argsort(self.vectors, axis=0, kind="stable")
        # float64 holds these sums exactly below 2^53, and its products are much faster
        largest = int(np.abs(self.vectors).max(initial=0))
        self.exact = self.vectors.astype(np.float64)
        self.largest, self.width = largest, vectors.shape[1]

    def fits(self, query: np.ndarray) -> bool:
        return self.largest * int(np.abs(query).max(initial=0)) * max(self.width, 1) < 2**53

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.fits(query):
            return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best by (score, smaller id); rows are in the order of ids."""
        keep = self.ids[rows] != own
        rows, scores = rows[keep], scores[keep]
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            some = scores >= least
            rows, scores = rows[some], scores[some]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def top(self, query: np.ndarray, own: int, k: int):
        """The k best rows and scores, or None while the bound is not below the k-th."""
        n = len(self.ids)
        rising, falling = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for depth in DEPTHS:
            if depth >= n:
                return None
            met = np.zeros(n, bool)
            met[self.up[:depth, rising].ravel()] = True
            met[self.up[n - depth :, falling].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            rows, scores = self.best(np.concatenate([rows, new]), np.concatenate([scores, self.scores(query, new)]), k, own)
            bound = sum(int(query[d]) * int(self.vectors[self.up[depth - 1, d], d]) for d in rising)
            bound += sum(int(query[d]) * int(self.vectors[self.up[n - depth, d], d]) for d in falling)
            if len(rows) == k and bound < scores[-1]:
                return rows, scores
        return None


def _search(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        lists = Lists(candidates["vec_id"].to_numpy(), np.stack(candidates["v"].to_numpy()).astype(np.int64))
        q = np.stack(queries["v"].to_numpy()).astype(np.int64)
        ids = queries["query_id"].to_numpy()
        found, open_ = [], []
        for i in range(len(q)):
            got = lists.top(q[i], ids[i], k)
            open_.append(i) if got is None else found.append((i, *got))
        every = np.arange(len(lists.ids))
        step = max(1, (1 << 22) // len(every))
        for at in range(0, len(open_), step):  # the rest of the lists, to their end
            some = open_[at : at + step]
            if all(lists.fits(q[i]) for i in some):
                whole = (q[some].astype(np.float64) @ lists.exact.T).astype(np.int64)
            else:
                whole = q[some] @ lists.vectors.T
            found += [(i, *lists.best(every, s, k, ids[i])) for i, s in zip(some, whole)]
        return pd.DataFrame({
            "query_id": np.concatenate([np.full(len(r), ids[i]) for i, r, _ in found]),
            "vec_id": np.concatenate([lists.ids[r] for _, r, _ in found]),
            "score": np.concatenate([s for _, _, s in found]),
        }).astype("int64")

    return search


def top_k(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of ``vectors(vec_id, v array<long>)`` where ``is_query`` holds."""
    usable = vectors.filter("vec_id is not null and v is not null and forall(v, x -> x is not null)")
    one = usable.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    n, n_queries = one.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, parts = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    place = F.xxhash64("vec_id")
    candidates = one.select("vec_id", "v", "dims", F.pmod(place, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    queries = one.filter(is_query).select(F.col("vec_id").alias("query_id"), "v", "dims", F.pmod(place, F.lit(parts)).cast("int").alias("part"),
                                          F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"))
    keys = ["dims", "shard", "part"]
    local = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k), _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
