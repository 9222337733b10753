import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.helpers import row_set
from weighbridge.llm.prefix_trie import Parentheses, prefix_trie

DDL = "conv_id long, turn long, role string, text string, path string, base long, words int, kind string"


def turns(spark, *rows):
    """Rows (conv_id, turn, role, text) beside columns with the operator's own names."""
    return spark.createDataFrame([(*r, "p", 1, 2, "tree") for r in rows], DDL)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) % 20 * (1 if c >= 0 else -1)  # the remainder has the sign of c
        path = tuple(own.get(c - base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path) == d))
    out = []
    for x, members in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        leaves = [y for y in below if not any(len(z) == len(y) + 1 and z[:-1] == y for z in below)]
        saved = sum((len(nodes[y]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", y[-1][1])) for y in below if y)
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        out.append((min(members)[0], len(x), min(nodes[x[:-1]])[0] if x else None, len(members),
                    sum(1 for y in below if len(y) == len(x) + 1), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_findclose_matches_a_stack(block):
    rng = random.Random(block)
    for n in (1, 2, 30, 700):
        for chance in (0.4, 0.8):
            bits, stack, left = [1], 1, n
            while left or stack > 1:
                up = left and (stack == 1 or rng.random() < chance)
                bits.append(int(bool(up)))
                stack += 1 if up else -1
                left -= 1 if up else 0
            bits.append(0)
            close, opened = {}, []
            for i, b in enumerate(bits):
                if b:
                    opened.append(i)
                else:
                    close[opened.pop()] = i
            bp = Parentheses(np.array(bits, np.uint8), block)
            at = np.flatnonzero(bp.bits)
            assert bp.findclose(at).tolist() == [close[i] for i in at.tolist()]


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), -7, -20]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "c\td  e", "é x"])))
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 40, 1 << 18])
def test_equals_brute_force_at_any_shard_size(spark, shard_turns):
    rows = random_rows(shard_turns)
    assert row_set(prefix_trie(turns(spark, *rows), shard_turns)) == brute(rows)


def test_hot_conversation_first_turn_and_long_conversation(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 900) for t in range(2)]
    rows += [(c, t, "user", "hello 0" if t == 0 else f"{c}") for c in range(1000, 1100) for t in range(3)]
    rows += [(5000, t, "user", f"turn {t % 50}") for t in range(3000)]
    got = prefix_trie(turns(spark, *rows), 64).cache()
    assert got.count() > 3000
    root = got.filter("depth = 0").collect()
    assert len(root) == 1 and root[0].n_convs == 1001 and root[0].conv_id == 0
    small = [r for r in rows if r[0] < 1000 or 1000 <= r[0] < 1100]
    assert row_set(prefix_trie(turns(spark, *small), 64)) == brute(small)
    deepest = got.filter("conv_id = 5000").agg({"depth": "max"}).first()[0]
    assert deepest == 3000 and got.filter("depth = 2999 and conv_id = 5000").first().n_children == 1


def test_nulls_ties_repeated_rows_turnless_and_empty(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"),
            (2, 0, "user", "only"), (3, 0, "user", "a"), (23, 5, None, "w w w"), (43, 5, None, "w w w")]
    assert row_set(prefix_trie(turns(spark, *rows), 2)) == brute(rows)
    turnless = [(c, 0, "user", "x") for c in range(21, 40)]  # no conversation 20: those with h > 0 have no turn left
    assert row_set(prefix_trie(turns(spark, *turnless), 3)) == brute(turnless)
    assert prefix_trie(turns(spark, (None, 0, "user", "x")).limit(0)).count() == 0
