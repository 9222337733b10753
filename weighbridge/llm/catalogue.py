"""The registered queries of the operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


_OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS et,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS er,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, sum(length(er) + length(et) + 14) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op5_chat_format", _OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, examples

    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(examples(turns.unionByName(extra)))


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels.filter(~held_out(5, 0))))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.filter(~held_out(3, 1))))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


_OP8_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op8_topk", _OP8_SQL)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = table(spark, sf_dir, "embeddings").filter(finite)
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> floor(64 * double(x)))").alias("v"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode, load

    found = encode(table(spark, sf_dir, "documents"), load())
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip")


_OP7_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
    strlen(coalesce(html, '')) AS payload_bytes FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM f
"""


@query("op7_warc", _OP7_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_number, round_trip

    rows = round_trip(table(spark, sf_dir, "pages"))
    size = F.regexp_extract("metadata.block", r"payload-bytes: (\d+)", 1).cast("long")
    return rows.select(
        page_number(F.col("capture")).alias("page_id"), F.coalesce("response.payload_bytes", size).alias("payload_bytes"),
        F.coalesce("response.payload_sha256", "response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        page_number(F.col("response.refers_to")).alias("refers_to"),
    )


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removal_report

    return removal_report(table(spark, sf_dir, "documents"), length=400, keep_first=False)


def _op9_sql() -> str:
    from .licences import template_pairs

    values = ", ".join(f"('{licence}', {number}, {size}, '{pair}')" for licence, number, size, pair in template_pairs())
    return rf"""
WITH t(licence, template, size, pair) AS (VALUES {values}),
u AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, text AS unit FROM documents
    UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents
    UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?:])\s+', '\1' || chr(10), 'g'), chr(10))) FROM documents
  ) WHERE doc_id IS NOT NULL
), w AS (
  SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM u
), p AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM w
), e AS (SELECT doc_id, unit, len(pairs) AS n, unnest(pairs) AS pair FROM p),
c AS (
  SELECT doc_id, unit, licence, 2 * count(*) / (any_value(n) + any_value(size)) AS dice
  FROM e JOIN t USING (pair) GROUP BY doc_id, unit, licence, template
), b AS (SELECT doc_id, unit, licence, max(dice) AS dice FROM c WHERE dice >= 0.8 GROUP BY ALL)
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_units FROM b GROUP BY ALL
"""


@query("op9_licences", _op9_sql())
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


# unsigned CRC-32 of a decimal number, byte by byte (DuckDB has no function for it)
_CRC_SQL = """
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(n)))"""
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
    lambda c, b: xor(crc_table.t[(xor(c, b) & 255) + 1], c >> 8)))"""


_OP11_SQL = rf"""
WITH {_CRC_SQL},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, list({{'name': name, 'words': words}} ORDER BY turn NULLS FIRST, role, name) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, ({_CRC.format(x="conv_id")} % 4)::INTEGER AS h FROM w, crc_table),
c AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN w b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, len(ts) AS n, list_transform(ts, lambda x: x.name) AS names, list_transform(ts, lambda x: x.words) AS words FROM c),
m AS (SELECT conv_id, n, unnest(range(0, n + 1)) AS depth, names, words FROM p),
k AS (SELECT conv_id, n, depth, md5(array_to_string(names[:depth], '')) AS node, md5(array_to_string(names[:depth - 1], '')) AS above,
        names[:depth] AS path, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words FROM m),
g AS MATERIALIZED (SELECT node, depth, CASE WHEN depth > 0 THEN any_value(above) END AS above, any_value(path) AS path, min(conv_id) AS conv_id,
        count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM k GROUP BY node, depth),
a AS (SELECT above AS node, count(*) AS n_children FROM g WHERE above IS NOT NULL GROUP BY above),
u AS (SELECT md5(array_to_string(g.path[:d], '')) AS node, saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
      FROM (SELECT g.*, n_children, unnest(range(0, depth + 1)) AS d FROM g LEFT JOIN a USING (node)) g),
s AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM u GROUP BY node)
SELECT g.conv_id, g.depth, b.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, g.ends_sha256
FROM g JOIN s USING (node) LEFT JOIN a USING (node) LEFT JOIN g b ON b.node = g.above
"""


@query("op11_prefix_trie", _OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def _op12_sql(levels: int = 6) -> str:
    """Levels are written out: ``levels`` of them hold 16^6 leaves a source and sources."""
    def field(x: str, text: bool = True) -> str:
        size = f"strlen({x}::VARCHAR)" if text else f"length({x}::VARCHAR)"
        return f"coalesce({size} || ':' || {x}, '-')"

    start = " || ".join([field("doc_id", False), field("source"), field("lang"), field("n_chars", False)])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [_CRC_SQL.strip(), f"""
d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({start} || {field("text")}) AS leaf,
  CASE WHEN {_CRC.format(x="doc_id")} % 5 = 0 THEN sha256({start} || {field(lower)}) END AS altered FROM documents, crc_table),
a0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)"""]

    def level(prefix: str, k: int) -> None:
        steps.append(f"""
{prefix}{k + 1} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, CASE WHEN n > 1 THEN ceil(n / 16.0)::BIGINT ELSE 1 END AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {prefix}{k} GROUP BY tree, pos // 16, n)""")
        steps.append(f"""
{prefix}s{k} AS MATERIALIZED (SELECT tree, pos // 16 AS run, n > 1 AS many, list(h ORDER BY pos) AS hs FROM {prefix}{k} GROUP BY tree, pos // 16, n > 1)""")

    for k in range(levels):
        level("a", k)
    steps.append(f"\nb0 AS MATERIALIZED (SELECT '2' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    for k in range(levels):
        level("b", k)
    steps.append(f"""
c0 AS (SELECT a0.doc_id, a0.leaf, a0.tree, a0.pos AS apos, b0.pos AS bpos, b0.h AS subroot, coalesce(a0.altered, a0.leaf) AS f, '' AS proof
  FROM a0 JOIN b0 ON b0.source = a0.tree)""")
    number = 0
    for prefix in "ab":
        tree, pos = ("c.tree", "apos") if prefix == "a" else ("'2'", "bpos")
        for k in range(levels):
            i = f"({pos} // {16 ** k} % 16)"
            before, after = f"array_to_string(s.hs[:{i}], '')", f"array_to_string(s.hs[{i} + 2:], '')"
            steps.append(f"""
c{number + 1} AS (SELECT doc_id, leaf, c.tree, apos, bpos, subroot, CASE WHEN many THEN sha256({before} || f || {after}) ELSE f END AS f,
  CASE WHEN many THEN proof || {before} || {after} ELSE proof END AS proof FROM c{number} c JOIN {prefix}s{k} s ON s.tree = {tree} AND s.run = {pos} // {16 ** (k + 1)})""")
            number += 1
    return "WITH " + ",".join(steps) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM c{number}, b{levels} r
"""


@query("op12_merkle_manifest", _op12_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query("op13_vector_dedup")
def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)
