r"""Merkle manifest of a table of documents, and its proof for every document.

A leaf is the SHA-256 of a document's fields. Per source the leaves, by doc_id, are hashed in runs of
``RUN`` until one node is left, the subroot; the subroots, by source, are hashed the same way to
the root. Hashes are lower-case hex; a run's hash is that of its hashes one after the other.

* Places within a source come from one range sort by (source, doc_id) and the counts of each
  sorted part, so a source of any size is spread over tasks.
* Each level is one aggregation of the level below. Every node is stored with its place, the place
  of its parent, and the siblings before and after it (``links``).
* A recursive query climbs these links from every run of leaves: a step appends the siblings of
  the current node to the proof and folds each leaf's own hash, altered or not, with them. The leaves of a
  run stand in one row, as their way up is the same, so a row carries one proof for up to 16 leaves, and
  a leaf's own siblings are added at the end.

A tampered document's leaf is hashed from its changed text while all siblings stay as they were, so
its climb must end at another hash than the root, and every other document's at the root.

Rows: null fields count as ``-``, so null and empty differ. Rows without doc_id come first in
their source and are never tampered with; documents without source form a source of their own, before the others.
Rows that repeat a doc_id stand side by side, by their leaf's hash. An empty table gives no row. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import settle

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROOT = "2"  # sorts after the trees of the sources: "0" (null) and "1" with the name
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered): altered is the leaf of the lower-cased text where 5 divides crc32(doc_id)."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", _UPPER, _UPPER.lower())
    return docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(F.col("text")).alias("leaf"), F.when(tampered, leaf_hash(lower)).alias("altered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... by ``order`` within ``group``) and ``total`` (rows of the group).

    ``rows`` is read twice, so pass a stored table. ``group`` must not be null.
    """
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = settle(sorted_.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    parts = placed.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy(group)
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = settle(parts.select(group, "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(whole).alias("total")))
    return placed.join(parts, [group, "part"]).withColumn("pos", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


def _next_level(nodes: DataFrame, child: Column) -> DataFrame:
    """Runs of ``nodes(tree, pos, total, digest)`` as parents (tree, pos, total, children, digest)."""
    runs = nodes.groupBy("tree", F.expr(f"pos div {RUN}").alias("up"), "total").agg(F.array_sort(F.collect_list(child)).alias("children"))
    return runs.select("tree", F.col("up").alias("pos"), F.ceil(F.col("total") / RUN).alias("total"), "children", F.sha2(F.array_join("children.digest", ""), 256).alias("digest"))


def _links(parents: DataFrame, up_level: int, tree: Column, level: Column, pos: Column) -> DataFrame:
    """A row per child of ``parents``: its place, the parent's place and hash, and its siblings before and after."""
    child = parents.select(
        F.col("tree").alias("up_tree"), F.lit(up_level).alias("up_level"), F.col("pos").alias("up_pos"), F.col("digest").alias("up_digest"),
        F.col("children.digest").alias("hashes"), F.posexplode("children").alias("i", "child"))
    return child.select(
        tree.alias("tree"), level.alias("level"), pos.alias("pos"), "up_tree", "up_level", "up_pos", F.unhex("up_digest").alias("up_digest"),
        F.expr("unhex(array_join(slice(hashes, 1, i), ''))").alias("before"), F.expr("unhex(array_join(slice(hashes, i + 2, size(hashes)), ''))").alias("after"))


def _climbing(nodes: DataFrame, links: list[DataFrame], tops: list[DataFrame], level: int = 1) -> int:
    """Hash ``nodes(tree, pos, total, digest)`` level by level; the level of the last node.

    Adds the links of each level and the nodes that are left alone in their tree. Only the largest
    ``total`` comes to the driver.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        tops.append(nodes.filter("total = 1").select("tree", F.lit(level).alias("level"), "digest"))
        parents = settle(_next_level(nodes.filter("total > 1"), F.struct("pos", "digest")))
        links.append(_links(parents, level + 1, F.col("up_tree"), F.lit(level), F.col("child.pos")))
        nodes, level, most = parents.select("tree", "pos", "total", "digest"), level + 1, -(-most // RUN)
    tops.append(nodes.filter("total = 1").select("tree", F.lit(level).alias("level"), "digest"))
    return level


def _together(parts: list[DataFrame]) -> DataFrame:
    return settle(reduce(DataFrame.unionByName, parts))


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, int]]:
    """(runs, links, root) of the manifest of ``docs``.

    runs: tree, pos, total (runs of the tree), items (pos, doc_id, leaf, altered), digest;
    links: tree, level, pos, up_tree, up_level, up_pos, up_digest, before, after of every node but the root;
    root: the tree and the level of the root.
    """
    rows = numbered(settle(leaves(docs)), "tree", ["doc_id", "leaf"])
    items = F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "altered")))
    runs = rows.groupBy("tree", F.expr(f"pos div {RUN}").alias("run"), "total").agg(items.alias("items"))
    # a lone leaf is its tree's subroot itself
    digest = F.when(F.col("total") == 1, F.col("items")[0]["leaf"]).otherwise(F.sha2(F.array_join("items.leaf", ""), 256))
    runs = settle(runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("total") / RUN).alias("total"), "items", digest.alias("digest")))
    links: list[DataFrame] = []
    tops: list[DataFrame] = []
    _climbing(runs.select("tree", "pos", "total", "digest"), links, tops)

    # the subroots are the leaves of one more tree
    subroots = _together(tops).select(F.lit(_ROOT).alias("tree"), F.col("tree").alias("of"), F.col("level").alias("of_level"), "digest")
    subroots = settle(numbered(subroots, "tree", ["of"]))
    known = subroots.agg(F.count("*"), F.min("of"), F.min("of_level")).first()
    if known[0] < 2:  # a single source's subroot is the root
        return runs, _together(links) if links else _no_links(docs.sparkSession), (known[1] or "", known[2] or 0)
    parents = settle(_next_level(subroots, F.struct("pos", "digest", "of", "of_level")))
    links.append(_links(parents, 1, F.col("child.of"), F.col("child.of_level"), F.lit(0).cast("long")))
    level = _climbing(parents.select("tree", "pos", "total", "digest"), links, [])
    return runs, _together(links), (_ROOT, level)


def _no_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "tree string, level int, pos long, up_tree string, up_level int, up_pos long, up_digest binary, before binary, after binary")


@contextmanager
def _unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """Spark ends a recursive query after a million rows unless told otherwise."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def climb(runs: DataFrame, links: DataFrame, root: tuple[str, int]) -> DataFrame:
    """(tree, pos, folded, proof, subroot, root) per run, at the end of its way up; hashes are binary.

    ``proof`` holds the siblings above the run, ``folded`` what each of its leaves, altered or not, makes of
    the root. Every step of a recursive query is written and kept, so rows carry nothing else.
    """
    spark = runs.sparkSession
    starts = runs.selectExpr("tree", "1 AS level", "pos", "pos AS run", """transform(items, (x, i) -> unhex(
      if(size(items) = 1 and total = 1, coalesce(x.altered, x.leaf), sha2(concat(
        array_join(slice(items.leaf, 1, i), ''), coalesce(x.altered, x.leaf), array_join(slice(items.leaf, i + 2, size(items)), '')), 256)))) AS folded""", "unhex(digest) AS digest")
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in ("starts", "links")}
    starts.createOrReplaceTempView(names["starts"])
    links.createOrReplaceTempView(names["links"])
    try:
        with _unlimited_recursion(spark):
            ways = spark.sql(f"""
              WITH RECURSIVE climb (of, run, tree, level, pos, folded, proof, subroot, digest) AS (
                SELECT tree, run, tree, level, pos, folded, X'', digest, digest FROM {names["starts"]}
                UNION ALL
                SELECT c.of, c.run, l.up_tree, l.up_level, l.up_pos,
                  transform(c.folded, x -> unhex(sha2(lower(concat(hex(l.before), hex(x), hex(l.after))), 256))),
                  concat(c.proof, l.before, l.after), if(l.up_tree = '{_ROOT}', c.subroot, l.up_digest), l.up_digest
                FROM climb c JOIN {names["links"]} l ON c.tree = l.tree AND c.level = l.level AND c.pos = l.pos
              ) SELECT of AS tree, run AS pos, folded, proof, subroot, digest AS root FROM climb WHERE tree = :tree AND level = :level""",
                             {"tree": root[0], "level": root[1]})
            return settle(ways)
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    runs, links, root = build(docs)
    ways = climb(runs, links, root).join(runs.select("tree", "pos", "items"), ["tree", "pos"])
    each = ways.select("proof", "subroot", "root", "folded", F.col("items.leaf").alias("hashes"), F.posexplode("items").alias("i", "x"))
    proof = F.expr("concat(array_join(slice(hashes, 1, i), ''), array_join(slice(hashes, i + 2, size(hashes)), ''), lower(hex(proof)))")
    folded = F.col("folded")[F.col("i")]
    return each.select(
        "x.doc_id", "x.leaf", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"), F.sha2(proof, 256).alias("proof_sha256"),
        F.lower(F.hex(folded)).alias("folded_root"), (folded == F.col("root")).alias("verified"))
