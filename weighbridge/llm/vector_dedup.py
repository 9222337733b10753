r"""Near duplicates among vectors by sorted projection passes.

A pass projects every vector on random directions, ``DIRECTIONS`` at a time; each set of directions gives a
digit, the direction with the largest absolute projection and its sign. The digits one after the other
are the pass's key. Vectors in order of key stand beside vectors that share its first
digits, and every vector is compared with the ``WINDOW`` vectors after it. The passes, each with other
directions, are sorted together by (pass, key, node) and read partition by partition; the windows that cross
the edge of a partition come from the rows at its ends, so what is found does not depend on the partitions.

A pair whose cosine just reaches the threshold shares a digit with the chance ``agreement``, and about
log(nodes / window) / log(2 * directions) digits must be shared to stand in one window. ``passes`` takes as
many passes as leave such a pair unfound with a chance of at most ``MISS``; more similar pairs are found
more surely. Candidates are taken by 128 sign bits and verified on the vectors in double precision.

Equal vectors become one node first. Groups of near copies become balls: all members lie within half
of the threshold's angle of a leader, so every two of them are linked by the triangle inequality, and are counted by the ball's size
instead of pair by pair. Leaders are met in order of key, united over partitions by the
passes among the leaders of two or more, and at the end vectors that are linked with a larger ball join it
if they are within its radius. Windows report pairs of different balls only, so a group of near copies of any
size adds one row a vector. Links between different balls are those that the windows find.

Rows: a vector that is null, empty, zero, or holds null or non-finite components is linked with nothing; so are
vectors of different length with each other. Rows without vec_id are left out. Rows that repeat a vec_id are one
vector, the smallest of them by hash, and give one row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settle
from .components import components

WINDOW = 256
DIRECTIONS = 16
DIGITS = 8  # 5 bits each: 40 bits of key
MISS = 0.01
SALTS = 16
_LEADERS = 64
_SEED = 20240607


def agreement(cosine: float, directions: int = DIRECTIONS) -> float:
    """The chance that two vectors of this cosine have the same digit, by a seeded trial."""
    draws = np.random.default_rng(_SEED).standard_normal((2, 20000, directions))
    x, y = draws[0], cosine * draws[0] + math.sqrt(1 - cosine**2) * draws[1]
    i, j, row = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1), np.arange(20000)
    return float(((i == j) & (np.sign(x[row, i]) == np.sign(y[row, j]))).mean())


def passes(nodes: int, cosine: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair of this cosine is unfound with a chance of at most ``miss``."""
    digits = max(math.log(max(nodes, 1) / window, 2 * DIRECTIONS), 0.0)
    once = agreement(cosine) ** digits
    return 1 if once > 1 - miss else math.ceil(math.log(miss) / math.log(1 - once))


def most_bits_apart(cosine: float, bits: int = 128) -> int:
    """Sign bits in which a pair of this cosine differs at most, but for a chance below 1e-6 (five deviations)."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors as doubles) of an array column, one entry per length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        found.append((rows, flat[starts[rows][:, None] + np.arange(size)]))
    return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is taken out first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _directions(which: int, size: int, count: int) -> np.ndarray:
    return np.random.default_rng([_SEED, which, size]).standard_normal((size, count))


def _keys(vectors: np.ndarray, which: int) -> np.ndarray:
    """The key of pass ``which``: the length of the vectors, then the digits."""
    projected = (vectors @ _directions(which, vectors.shape[1], DIGITS * DIRECTIONS)).reshape(len(vectors), DIGITS, DIRECTIONS)
    best = np.abs(projected).argmax(axis=2)
    sign = np.take_along_axis(projected, best[:, :, None], axis=2)[:, :, 0] > 0
    base = 2 * DIRECTIONS
    key = ((best * 2 + sign) * base ** np.arange(DIGITS)[::-1]).sum(axis=1)
    return key + vectors.shape[1] % 2**20 * base**DIGITS


def _signs(vectors: np.ndarray) -> np.ndarray:
    """Two numbers of 64 sign bits."""
    bits = vectors @ _directions(2**31, vectors.shape[1], 128) > 0
    return np.packbits(bits, axis=1).view(np.int64)


def _salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, one row per ``key``; a key that many rows hold is dealt to SALTS tasks.

    The copies are never broadcast: Spark would size them by the file of ``table`` alone, and the driver would hold all SALTS of them.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), [key, "salt"], how).drop("salt")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of ``rows(vec_id, v)``.

    nodes: node (the smallest vec_id of equal vectors), copies, v; members: vec_id, node of every usable row.
    """
    finite = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"
    name = F.struct(F.xxhash64("v").alias("f"), F.xxhash64("v", F.lit(1)).alias("g"), F.size("v").alias("s"))
    usable = rows.filter("vec_id is not null").filter(finite).withColumn("name", name)
    # names stand for vectors, so copies are counted without moving vectors
    named = settle(usable.groupBy("vec_id").agg(F.min("name").alias("name")))
    groups = settle(named.groupBy("name").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    chosen = groups.select(F.col("node").alias("vec_id"), "name", "copies")
    vectors = usable.join(chosen, ["vec_id", "name"]).groupBy("vec_id", "name").agg(F.any_value("copies").alias("copies"), F.any_value("v").alias("v"))
    members = _salted_join(named, groups.filter("copies > 1").select("name", "node"), "name", "vec_id", "left")
    return vectors.select(F.col("vec_id").alias("node"), "copies", "v"), members.select("vec_id", F.coalesce("node", "vec_id").alias("node"))


def sketches(nodes: DataFrame, count: int) -> DataFrame:
    """node, copies, v, lead (key of the leaders' pass), s1, s2 (sign bits), keys (one per pass)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                keys, signs = np.zeros((n, count + 1), np.int64), np.zeros((n, 2), np.int64)
                for rows, vectors in _matrix(part.column("v")):
                    unit = _unit(vectors)
                    signs[rows] = _signs(unit)
                    for which in range(count + 1):
                        keys[rows, which] = _keys(unit, which)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), pa.array(np.ascontiguousarray(keys[:, 1:]).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("copies"), part.column("v"), pa.array(keys[:, 0].copy()), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy()), lists],
                    ["node", "copies", "v", "lead", "s1", "s2", "keys"])

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.mapInArrow(sketch, f"node long, copies long, v {kind}, lead long, s1 long, s2 long, keys array<long>")


def _leading(radius: float):
    """Each vector's leader: one of the last met within ``radius`` (a cosine), or itself."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        clock = 0
        for batch in batches:
            leader = np.zeros(batch.num_rows, np.int64)
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            for rows, vectors in _matrix(batch.column("v")):
                unit = _unit(vectors)
                if unit.shape[1] not in known:
                    known[unit.shape[1]] = [np.zeros((_LEADERS, unit.shape[1])), np.zeros(_LEADERS, np.int64), np.full(_LEADERS, -1)]
                matrix, names, last = known[unit.shape[1]]
                for row, u in zip(rows.tolist(), unit):
                    clock += 1
                    near = matrix @ u
                    best = int(near.argmax())
                    if near[best] < radius:
                        best = int(last.argmin())
                        matrix[best], names[best] = u, ids[row]
                    last[best] = clock
                    leader[row] = names[best]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(leader)], ["node", "ball"])

    return lead


_ROW = "part long, place long, pass int, node long, ball long, s1 long, s2 long"


def _window_rows(window: int, bits: int):
    """Candidate pairs (node, ball as the two ids, part null) of a sorted partition, and the rows at its ends."""
    names = [f.split()[0] for f in _ROW.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), t) for t in types]
        none[3], none[4] = pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))
        return pa.RecordBatch.from_arrays(none, names)

    def ends(part: int, first: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(first, first + n)), *[pa.array(c, t) for c, t in zip(columns, types[2:])]], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pass", "node", "ball", "s1", "s2")]
            if seen < window:
                yield ends(part, seen, [c[: window - seen] for c in new])
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            old, n = (0 if held is None else len(held[0])), len(rows[0])
            which, node, ball, s1, s2 = rows
            s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
            left, right = [], []
            for step in range(1, min(window, n - 1) + 1):
                lo = max(old - step, 0)
                i, j = slice(lo, n - step), slice(lo + step, n)
                apart = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int16) + np.bitwise_count(s2[i] ^ s2[j])
                hit = np.flatnonzero((apart <= bits) & (ball[i] != ball[j]) & (which[i] == which[j]))
                if len(hit):
                    left.append(node[lo + hit])
                    right.append(node[lo + hit + step])
                if sum(map(len, left)) > 1 << 16:
                    yield pairs_of(np.concatenate(left), np.concatenate(right))
                    left, right = [], []
            if left:
                yield pairs_of(np.concatenate(left), np.concatenate(right))
            seen += batch.num_rows
            held = [c[-window:] for c in rows]
        if held is not None and seen > window:
            # rows at the start are out already
            size = min(len(held[0]), seen - window)
            yield ends(part, seen - size, [c[-size:] for c in held])

    return compare


def _verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with a cosine of at least ``least``, in double precision."""
    both = (pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("x")), "a")
            .join(vectors.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").filter("size(x) = size(y)"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            right = {int(r): v for rows, vs in _matrix(batch.column("y")) for r, v in zip(rows, _unit(vs))}
            for rows, vectors in _matrix(batch.column("x")):
                good[rows] = np.einsum("ij,ij->i", _unit(vectors), np.array([right[int(r)] for r in rows])) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def window_links(rows: DataFrame, vectors: DataFrame, least: float, window: int) -> DataFrame:
    """Links (a, b) between different balls of ``rows(node, ball, s1, s2, keys)`` that the windows of all passes find."""
    bits = most_bits_apart(least)
    spread = rows.select("node", "ball", "s1", "s2", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "key", "node"]
    sorted_ = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle(sorted_.mapInArrow(_window_rows(window, bits), _ROW))
    ends = found.filter("part is not null")
    # one row a partition: where its rows begin in the whole order
    size = ends.groupBy("part").agg((F.max("place") + 1).alias("n"))
    begin = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    ends = settle(ends.join(begin, "part").withColumn("rank", F.col("begin") + F.col("place")).drop("begin", "place"))
    block = F.expr(f"rank div {window}")
    right = ends.select(*[F.col(c).alias(f"{c}_") for c in ends.columns], F.explode(F.array(block, block - 1)).alias("block"))
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_")))
    across = ends.withColumn("block", block).join(right, "block").filter(
        (F.col("rank_") - F.col("rank")).between(1, window) & (F.col("part") != F.col("part_")) & (F.col("pass") == F.col("pass_"))
        & (F.col("ball") != F.col("ball_")) & (apart <= bits))
    pairs = found.filter("part is null").select(F.col("node").alias("a"), F.col("ball").alias("b")).union(
        across.select(F.least("node", "node_"), F.greatest("node", "node_"))).distinct()
    return settle(_verified(pairs, vectors, least))


def united(balls: DataFrame, links: DataFrame, vectors: DataFrame, radius: float) -> DataFrame:
    """``balls(node, ball)`` after balls joined the largest ball that links connect them with.

    A ball joins only as a whole, when all its members lie within ``radius`` of the other's leader,
    so that two vectors of one ball never come apart.
    """
    ends = links.join(balls.select(F.col("node").alias("a"), F.col("ball").alias("x")), "a").join(balls.select(F.col("node").alias("b"), F.col("ball").alias("y")), "b")
    groups = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b").distinct())
    sizes = balls.groupBy(F.col("ball").alias("node")).agg(F.count("*").alias("size")).join(groups, "node")
    hubs = sizes.groupBy("component").agg(F.max_by("node", F.struct("size", -F.col("node"))).alias("hub"))
    targets = settle(groups.join(hubs, "component").filter("node != hub").select(F.col("node").alias("ball"), "hub"))
    moving = _salted_join(balls, targets, "ball", "node").join(vectors.select("node", "v"), "node")
    leaders = targets.select("hub").distinct().join(vectors.select(F.col("node").alias("hub"), F.col("v").alias("w")), "hub")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            right = {int(r): v for rows, vs in _matrix(batch.column("w")) for r, v in zip(rows, _unit(vs))}
            for rows, vs in _matrix(batch.column("v")):
                other = [right[int(r)] for r in rows]
                good[rows] = [len(o) == len(u) and float(o @ u) >= radius for o, u in zip(other, _unit(vs))]
            yield pa.RecordBatch.from_arrays([batch.column("ball"), batch.column("hub"), pa.array(good)], ["ball", "hub", "good"])

    near = _salted_join(moving, leaders, "hub", "node").select("ball", "hub", "v", "w").mapInArrow(reach, "ball long, hub long, good boolean")
    joining = settle(near.groupBy("ball").agg(F.bool_and("good").alias("all"), F.any_value("hub").alias("hub")).filter("all").select("ball", "hub"))
    return settle(_salted_join(balls, joining, "ball", "node", "left").select("node", F.coalesce("hub", "ball").alias("ball")))


def near_vectors(rows: DataFrame, least: float = 0.9, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """Per vector of ``rows(vec_id, v)``: vec_id, n_links, component_id, kept. ``least`` is the least cosine of a link."""
    radius = math.sqrt((1 + least) / 2) + 1e-12
    nodes, members = classes(rows)
    members = settle(members)
    count = passes(members.filter("vec_id = node").count(), least, window, miss)
    known = settle(sketches(nodes, count))
    vectors = known.select("node", "v")
    ordered = known.select("lead", "node", "v").repartitionByRange("lead", "node").sortWithinPartitions("lead", "node").select("node", "v")
    balls = settle(ordered.mapInArrow(_leading(radius), "node long, ball long"))

    leaders = balls.groupBy(F.col("ball").alias("node")).agg(F.count("*").alias("size")).filter("size > 1").select("node")
    of_leaders = settle(known.select("node", "s1", "s2", "keys").join(leaders, "node").withColumn("ball", F.col("node")))
    balls = united(balls, window_links(of_leaders, vectors, least, window), vectors, radius)
    links = window_links(settle(known.select("node", "s1", "s2", "keys").join(balls, "node")), vectors, least, window)
    balls = united(balls, links, vectors, radius)

    # what lies between different balls now, once per side
    copies = settle(known.select("node", "copies").join(balls, "node"))
    ends = links.join(copies.select(F.col("node").alias("a"), F.col("ball").alias("x"), F.col("copies").alias("m")), "a").join(
        copies.select(F.col("node").alias("b"), F.col("ball").alias("y"), F.col("copies").alias("n")), "b").filter("x != y")
    ends = settle(ends)
    outside = ends.select(F.col("a").alias("node"), F.col("n").alias("others")).union(ends.select("b", "m")).groupBy("node").agg(F.sum("others").alias("others"))
    groups = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    per_ball = copies.groupBy("ball").agg(F.sum("copies").alias("inside"), F.min("node").alias("low"))
    per_ball = per_ball.join(groups.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    lows = per_ball.groupBy("component").agg(F.min("low").alias("component_id"))
    per_ball = settle(per_ball.join(lows, "component").select("ball", "inside", "component_id"))
    found = _salted_join(balls, per_ball, "ball", "node").join(outside, "node", "left")
    found = settle(found.select("node", (F.col("inside") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    linked = _salted_join(members, found, "node", "vec_id")
    every = rows.filter("vec_id is not null").select("vec_id").distinct()
    component = F.coalesce("component_id", "vec_id")
    return every.join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def near_duplicates(table: DataFrame, least: float = 0.9) -> DataFrame:
    """Near duplicates of ``table(vec_id, embedding)``."""
    return near_vectors(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")), least)
