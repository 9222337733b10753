r"""Prefix trie of conversations as balanced parentheses, shard by shard.

A turn's name is the MD5 of its role and text, a conversation's path the names of its turns one
after the other. Sorted by path, conversations list the trie in preorder, so a shard (a run of
that order of about ``SHARD_TURNS`` turns) writes its part of the trie as balanced parentheses:
the length of the common prefix of two neighbours says how many nodes close and open between them.

* ``findclose`` finds the end of a node's subtree with the minima of blocks of the excess (opens
  less closes) and a tree of minima above them;
* a leaf is the pair ``()``: a rank over these pairs counts the leaves of a subtree;
* cumulative sums in preorder give the conversations and the savings of a subtree.

Only nodes on the first and the last path of a shard can stand in other shards too. These spines
are merged by the digest of their prefix: sums, less what was counted once per shard. The
corrections (a node saved once more per further shard, a leaf that is none elsewhere) go up
along the last path of the first shard that has the node. Every other node is final in its shard.
The ids that end at a spine node are digested in order, from pieces of at most ``PIECE`` characters.

A conversation is one row of some 25 bytes a turn, so a task holds a shard or its longest
conversation, however many conversations are equal or share a first turn.

Rows: a null role or text is empty, a null turn comes first, turns of equal number are ordered by role and
name. Rows without conv_id are left out. An empty table has no nodes, not even a root. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settle

SHARD_TURNS = 1 << 18
PIECE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_BLOCK = 64
_FAR = np.iinfo(np.int64).max


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with block minima of its excess."""

    def __init__(self, bits: np.ndarray, block: int = _BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        padded = np.full(-(-len(bits) // block) * block, _FAR)
        padded[: len(bits)] = self.excess
        self.minima = [padded.reshape(-1, block).min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            below = np.append(below, np.full(len(below) % 2, _FAR))
            self.minima.append(below.reshape(-1, 2).min(axis=1))
        # searches step past the end of a level before they go up
        self.minima = [np.append(level, [_FAR, _FAR]) for level in self.minima]

    def _scan(self, at: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First position from ``at`` to the end of its block with excess ``want``, else -1."""
        found = np.full(len(at), -1)
        todo, here = np.arange(len(at)), at.copy()
        while len(todo):
            hit = self.excess[here] == want[todo]
            found[todo[hit]] = here[hit]
            here += 1
            stay = ~hit & (here % self.block != 0) & (here < len(self.excess))
            todo, here = todo[stay], here[stay]
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        want = self.excess[at] - 1
        first = at + 1
        found = np.full(len(at), -1)
        inside = first % self.block != 0
        found[inside] = self._scan(first[inside], want[inside])
        far = np.flatnonzero(found < 0)
        node, goal = -(-first[far] // self.block), want[far]
        level = np.full(len(far), -1)
        up = np.arange(len(far))  # the searches that still go up
        for k, minima in enumerate(self.minima):
            met = minima[node[up]] <= goal[up]
            level[up[met]] = k
            up = up[~met]
            node[up] += 1
            right = up[node[up] % 2 == 1]
            met = minima[node[right]] <= goal[right]
            level[right[met]] = k
            node[right[~met]] += 1
            up = up[level[up] < 0]
            node[up] //= 2
        for k in range(len(self.minima) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            node[down] *= 2
            node[down] += self.minima[k - 1][node[down]] > goal[down]
            level[down] = k - 1
        found[far] = self._scan(node * self.block, goal)
        return found


def shard_nodes(ids: np.ndarray, lengths: np.ndarray, names: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of one shard in preorder, from conversations in order of path and id.

    ``names`` (two numbers a turn) and ``words`` hold the turns of all conversations one after the other.
    """
    n = len(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    common = np.zeros(n, np.int64)
    if n > 1:
        both = np.minimum(lengths[1:], lengths[:-1])
        some = np.flatnonzero(both)
        if len(some):
            size = both[some]
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            step = np.arange(size.sum()) - np.repeat(first, size)
            left, right = np.repeat(starts[some], size) + step, np.repeat(starts[some + 1], size) + step
            differ = (names[left] != names[right]).any(axis=1)
            common[some + 1] = np.minimum.reduceat(np.where(differ, step, np.repeat(size, size)), first)
    opens = lengths - common
    closes = np.concatenate([[0], lengths[:-1] - common[1:]])
    counts = np.concatenate([[1], np.stack([closes, opens], axis=1).ravel(), [lengths[-1] + 1]])
    marks = np.concatenate([[1], np.tile([0, 1], n), [0]]).astype(np.uint8)
    bp = Parentheses(np.repeat(marks, counts))

    opened = np.flatnonzero(bp.bits)
    closed = bp.findclose(opened)
    size = (closed - opened + 1) // 2
    pre = np.arange(len(opened))
    depth = bp.excess[opened] - 1
    conv = np.concatenate([[0], np.repeat(np.arange(n), opens)])
    last_words = np.concatenate([[0], words[starts[conv[1:]] + depth[1:] - 1]])
    ends_at = np.cumsum(opens)
    ended = np.concatenate([[0], np.cumsum(np.bincount(ends_at, minlength=len(pre)))])
    low, high = ended[pre], ended[pre + size]
    n_convs = high - low
    pairs = np.zeros(len(bp.bits) + 1, np.int64)
    pairs[1:-1] = np.cumsum((bp.bits[:-1] == 1) & (bp.bits[1:] == 0))
    saved = np.concatenate([[0], np.cumsum((n_convs - 1) * last_words)])
    key = np.sort(depth * (len(pre) + 1) + pre)
    above = np.searchsorted(key, (depth - 1) * (len(pre) + 1) + pre) - 1
    parent = np.where(depth > 0, key[np.maximum(above, 0)] % (len(pre) + 1), -1)
    return {
        "pre": pre, "depth": depth, "parent": parent, "n_convs": n_convs, "words": last_words, "low": low, "own": ended[pre + 1] - low,
        "conv_id": np.minimum.reduceat(np.append(ids, _FAR), np.stack([low, high], axis=1).ravel())[::2],
        "n_children": np.bincount(parent[1:], minlength=len(pre)),
        "n_leaves": pairs[closed] - pairs[opened], "saved": saved[pre + size] - saved[pre], "ends_at": ends_at,
    }


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation with the first turns of its template.

    Conversation c takes the first h turns of conversation c - c % 20, h = crc32(c) % 4, then its own
    after its first h. Both sides are dealt by c - c % 20, in one shuffle of names, not of texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    conv = F.col("conv_id").cast("long")
    turns = conversations.filter("conv_id is not null").select(
        (conv - conv % 20).alias("base"), conv.alias("conv_id"), F.struct(
            F.col("turn").alias("turn"), role.alias("role"), name.alias("name"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select("base", "conv_id", F.transform("ts", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("ts"))
    start = whole.filter("conv_id = base").select("base", F.slice("ts", 1, 3).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    own = F.slice("ts", h + 1, F.greatest(F.size("ts") - h, F.lit(0)))
    kept = F.coalesce(F.slice("start", F.lit(1), h), F.slice("ts", 1, 0))
    joined = whole.join(start, "base", "left").select("conv_id", F.concat(kept, own).alias("ts"))
    return joined.select("conv_id", F.unhex(F.array_join("ts.name", "")).alias("path"), F.col("ts.words").cast("array<int>").alias("words"))


_SCHEMA = ("kind string, shard long, pre long, parent long, last boolean, depth long, name binary, parent_name binary, conv_id long, parent_conv_id long, "
           "n_convs long, n_children long, n_leaves long, saved long, words long, ends string, seq long, text string")


def _shard_rows(shard: int, ids: np.ndarray, paths: list[bytes], words: np.ndarray) -> Iterator[dict]:
    lengths = np.array([len(p) // 16 for p in paths], np.int64)
    names = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    t = shard_nodes(ids, lengths, names, words)
    spine = np.zeros(len(t["pre"]), bool)
    digest: dict[int, bytes] = {}
    last = np.zeros(len(spine), bool)
    for which, i in ((False, 0), (True, len(ids) - 1)):
        # the nodes of a path: its end and the parents above
        node, line = int(t["ends_at"][i]), []
        while node >= 0:
            line.append(node)
            node = int(t["parent"][node])
        h = hashlib.blake2b(digest_size=16)
        for at, k in enumerate(reversed(line)):
            if at:
                h.update(paths[i][16 * (at - 1) : 16 * at])
            digest[k] = h.copy().digest()
        spine[line] = True
        last[line] = which
    parent = t["parent"]
    up = np.maximum(parent, 0)

    def joined(k: int) -> str:
        return ",".join(map(str, ids[t["low"][k] : t["low"][k] + t["own"][k]].tolist()))

    inner = np.flatnonzero(~spine)
    under = spine[up[inner]]
    ends = [hashlib.sha256(joined(k).encode()).hexdigest() if t["own"][k] else None for k in inner.tolist()]
    yield {"kind": pa.array(["tree"] * len(inner)), "shard": pa.array(np.full(len(inner), shard)), "parent": pa.array(up[inner], mask=~under),
           "parent_conv_id": pa.array(t["conv_id"][up[inner]], mask=under), "ends": pa.array(ends, pa.string()),
           **{c: pa.array(t[c][inner]) for c in ("pre", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "words")}}
    outer = np.flatnonzero(spine)
    yield {"kind": pa.array(["spine"] * len(outer)), "shard": pa.array(np.full(len(outer), shard)), "last": pa.array(last[outer]),
           "name": pa.array([digest[k] for k in outer.tolist()], pa.binary()),
           "parent_name": pa.array([digest[k] if k >= 0 else None for k in parent[outer].tolist()], pa.binary()),
           **{c: pa.array(t[c][outer]) for c in ("pre", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "words")}}
    pieces = []
    for k in outer.tolist():
        first, end, step = int(t["low"][k]), int(t["low"][k] + t["own"][k]), PIECE // 21
        pieces += [(digest[k], seq, ",".join(map(str, ids[lo : min(lo + step, end)].tolist()))) for seq, lo in enumerate(range(first, end, step))]
    yield {"kind": pa.array(["ends"] * len(pieces)), "shard": pa.array(np.full(len(pieces), shard)), "name": pa.array([p[0] for p in pieces], pa.binary()),
           "seq": pa.array([p[1] for p in pieces], pa.int64()), "text": pa.array([p[2] for p in pieces], pa.string())}


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _shards(shard_turns: int):
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in _SCHEMA.split(", "))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, paths, words, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _shard_rows(number, np.concatenate(ids), paths, np.concatenate(words).astype(np.int64))
            for part in rows:
                size = len(part["kind"])
                if size:
                    whole = pa.RecordBatch.from_arrays([part[f.name].cast(f.type) if f.name in part else pa.nulls(size, f.type) for f in schema], schema=schema)
                    for at in range(0, size, 8192):
                        yield whole.slice(at, 8192)

        for batch in batches:
            path, lists = batch.column("path"), batch.column("words")
            turns = np.maximum(np.diff(lists.offsets.to_numpy()), 1)
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(turns[at:]), max(shard_turns - held, 1), "right") + (0 if ids else 1)
                end = min(at + max(int(room), 0), batch.num_rows)
                if end > at:
                    ids.append(batch.column("conv_id").slice(at, end - at).to_numpy(zero_copy_only=False))
                    paths += path.slice(at, end - at).to_pylist()
                    words.append(lists.slice(at, end - at).flatten().to_numpy(zero_copy_only=False))
                    held += int(turns[at:end].sum())
                if end < batch.num_rows or held >= shard_turns:
                    yield from flush()
                    number, ids, paths, words, held = number + 1, [], [], [], 0
                at = end
        if ids:
            yield from flush()

    return build


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order."""
    name, h = None, None
    names, found = [], []
    for batch in batches:
        for here, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            if here != name:
                if h:
                    names.append(name)
                    found.append(h.hexdigest())
                name, h = here, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
    if h:
        names.append(name)
        found.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], ["name", "ends"])


def _merged(spine: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per spine node (name, parent_name, ...), over all shards."""
    leaf = F.col("n_children") == 0
    once = settle(spine.groupBy("name", "parent_name", "depth").agg(
        F.count("*").alias("k"), F.min("shard").alias("owner"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("words").alias("words"),
        F.count_if(leaf).alias("leaf")))
    shared = once.filter("k > 1")
    # a leaf in every shard counts once; a node that has children in some shard is no leaf
    changes = shared.select("name", "owner", F.expr("(k - 1) * words").alias("more"), F.expr("if(leaf = k, k - 1, leaf)").alias("fewer"))
    upward = Window.partitionBy("shard").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("owner") == F.col("shard")
    climbed = spine.filter("last").select("shard", "depth", "name").join(changes, "name").select(
        "name", F.sum(F.when(own, F.col("more"))).over(upward).alias("more"), F.sum(F.when(own, F.col("fewer"))).over(upward).alias("fewer"))
    climbed = climbed.groupBy("name").agg(F.sum("more").alias("more"), F.sum("fewer").alias("fewer"))
    twice = shared.filter("parent_name is not null").groupBy(F.col("parent_name").alias("name")).agg(F.sum(F.col("k") - 1).alias("twice"))
    digests = pieces.repartition("name").sortWithinPartitions("name", "shard", "seq").select("name", "text").mapInArrow(_fold, "name binary, ends string")

    def less(column: str, by: str):
        return (F.col(column) - F.coalesce(by, F.lit(0))).alias(column)

    return once.join(climbed, "name", "left").join(twice, "name", "left").join(digests, "name", "left").select(
        "name", "parent_name", "depth", "conv_id", "n_convs", less("n_children", "twice"), less("n_leaves", "fewer"),
        (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), "ends")


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie of ``paths(conv_id, path, words)``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (digest of the ids whose whole path the node is, in order, joined by commas).
    """
    stored = settle(paths.select("conv_id", "path", "words"))
    ordered = stored.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = settle(ordered.mapInArrow(_shards(shard_turns), _SCHEMA), ("kind",))
    spine = parts.filter("kind = 'spine'").drop("kind")
    merged = settle(_merged(spine, parts.filter("kind = 'ends'").select("name", "shard", "seq", "text")))
    above = merged.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    spines = merged.join(above, "parent_name", "left").select(*columns)
    # the children of a spine node are as many as a shard has, so the shard is part of the key
    lookup = spine.select("shard", F.col("pre").alias("parent"), "name").join(merged.select("name", F.col("conv_id").alias("spine_conv")), "name")
    inner = parts.filter("kind = 'tree'").join(lookup.drop("name"), ["shard", "parent"], "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "spine_conv")).select(*columns)
    none = hashlib.sha256(b"").hexdigest()
    return inner.unionByName(spines).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie_nodes(rebuilt(conversations), shard_turns)
