import hashlib
import random
import zlib

import pytest

from tests.helpers import row_set
from weighbridge.llm.manifest import manifest, numbered

DDL = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, leaf string, level int"


def documents(spark, *rows):
    """Rows (doc_id, source, lang, n_chars, text) beside columns with the operator's own names."""
    return spark.createDataFrame([(i, t, la, s, n, "x", 1, "y", 2) for i, s, la, n, t in rows], DDL)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(hashes):
    """Levels of a tree over ``hashes``, from the leaves to one node."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    """(before, after) per level above place ``at``."""
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def brute(rows):
    by_source = {}
    for i, s, la, n, t in rows:
        leaf = sha(*map(field, (i, s, la, n, t)))
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        lower = t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        changed = sha(*map(field, (i, s, la, n, lower))) if tampered else leaf
        by_source.setdefault(s, []).append((i is not None, i, leaf, changed))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by_source[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in sources}
    top = up([trees[s][-1][0] for s in sources])
    out = []
    for number, s in enumerate(sources):
        for at, (_, i, leaf, changed) in enumerate(sorted(by_source[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            steps = way(trees[s], at) + way(top, number)
            folded = changed
            for before, after in steps:
                folded = sha(before, folded, after)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], sha(*[b + a for b, a in steps]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def random_documents(count, sources, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 0, 7]), rng.choice(["Abc DEF", "abc", "", None, "É Ä Z", f"Doc {i}"]))
            for i in range(count)]


@pytest.mark.parametrize("count, sources", [
    (1, ["a"]), (1, [None]), (16, ["a"]), (17, ["a"]), (300, ["hot"]), (40, [f"s{i}" for i in range(60)]), (400, [None, "", "0", "é", "a", *["hot"] * 6])])
def test_equals_brute_force(spark, count, sources):
    rows = random_documents(count, sources)
    assert row_set(manifest(documents(spark, *rows))) == brute(rows)


def test_many_sources_make_several_levels(spark):
    rows = [(i, f"source {i:04d}", "en", 1, "T") for i in range(300)]
    got = manifest(documents(spark, *rows))
    assert row_set(got) == brute(rows)
    assert got.filter("verified").count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))


def test_null_and_repeated_ids_long_texts_and_empty_tables(spark):
    rows = [(None, "a", None, None, None), (None, "a", "en", 1, "X"), (5, "a", "en", 1, "X"), (5, "a", "en", 1, "X"), (5, "a", "de", 1, "x"),
            (-3, None, "en", 3, "Y" * 300_000), (9, None, "en", 3, "")]
    assert row_set(manifest(documents(spark, *rows))) == brute(rows)
    assert manifest(documents(spark, *rows).limit(0)).count() == 0


def test_row_limit_is_restored(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    manifest(documents(spark, *random_documents(20, ["a", "b"]))).count()
    assert spark.conf.get(key, None) == before


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', concat('s', id % 7)) AS g", "999 - id AS v").repartition(13)
    places = numbered(rows, "g", ["v"]).collect()
    of = {}
    for r in places:
        of.setdefault(r.g, []).append((r.pos, r.v, r.total))
    for group in of.values():
        group.sort()
        assert [p for p, _, _ in group] == list(range(len(group))) and {t for _, _, t in group} == {len(group)}
        assert [v for _, v, _ in group] == sorted(v for _, v, _ in group)
