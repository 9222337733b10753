"""Files, column work and negated predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outside, without_text
from ..operators.columns import drop_degenerate, drop_prefixed, keep, rename, snake_case, to_strings
from ..operators.reshape import append_rows
from ..sources import new_path, read_csv, read_csv_with_problems, read_parquet, write_result
from .registry import query
from .tables import STUDENTS_SQL, students, table, with_tables

_LABELS = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("label", T.StringType()), T.StructField("segment", T.StringType()),
])


@query("csv_round_trip", r"""
SELECT c_custkey, c_mktsegment AS segment,
       CASE c_custkey % 6 WHEN 0 THEN 'Say "' || c_name || '", twice' WHEN 1 THEN '  ' || c_name || ' ' WHEN 2 THEN NULL
            WHEN 3 THEN c_name || ', "' WHEN 4 THEN 'a\' || c_name ELSE c_name END AS label
FROM customer
""")
def csv_round_trip(spark, sf_dir):
    """Labels with quotes, commas, blanks, backslashes and missing values, through a CSV file."""
    name, case = F.col("c_name"), F.col("c_custkey") % 6
    label = (
        F.when(case == 0, F.concat(F.lit('Say "'), name, F.lit('", twice')))
        .when(case == 1, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(case == 3, F.concat(name, F.lit(', "')))
        .when(case == 4, F.concat(F.lit("a\\"), name))
        .when(case == 5, name)
    )
    path = new_path(spark, "csv-")
    rows = table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), F.col("c_mktsegment").alias("segment"))
    write_result(rows, path, "csv")
    return read_csv(spark, path, _LABELS)


@query("parquet_round_trip", "SELECT p_partkey, p_size FROM part WHERE p_size <= 25")
def parquet_round_trip(spark, sf_dir):
    """Written in partitions and read back under a declared schema; the filter prunes partitions."""
    path = new_path(spark, "parquet-")
    write_result(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path, partition_by=["p_size"])
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.IntegerType())])
    return read_parquet(spark, path, schema).where("p_size <= 25")


@query("typed_columns", """
SELECT p_name AS part_name, CAST(p_partkey AS VARCHAR) AS part_key, CAST(p_size AS VARCHAR) AS size_percent, p_retailprice AS x1_price
FROM part
""")
def typed_columns(spark, sf_dir):
    """Snake-case names, integers as text, a prefix dropped, columns in a stated order."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Part Key"), F.col("p_size").alias("size%"), F.col("p_retailprice").alias("1price"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("TMP_brand"), F.col("p_type").alias("TMP_type"),
    )
    tidy = drop_prefixed(part, "TMP_")
    tidy = rename(to_strings(snake_case(tidy), (T.IntegerType, T.LongType)), part_name="name", x1_price="x1price")
    return keep(tidy, ["part_name", "part_key", "size_percent", "x1_price", "absent"], strict=False)


@query("degenerate", """
WITH l AS (
  SELECT l_quantity AS quantity, CASE WHEN l_quantity < 0 THEN l_tax END AS blank, l_linestatus AS two_levels,
         CASE WHEN l_quantity > 10 THEN 'only' END AS one_level FROM lineitem)
SELECT column_name, n FROM (
  SELECT 'quantity' AS column_name, count(quantity) AS n, count(quantity) > 0 AS good FROM l
  UNION ALL SELECT 'blank', count(blank), count(blank) > 0 FROM l
  UNION ALL SELECT 'two_levels', count(two_levels), count(DISTINCT two_levels) > 1 FROM l
  UNION ALL SELECT 'one_level', count(one_level), count(DISTINCT one_level) > 1 FROM l) WHERE good
""")
def degenerate(spark, sf_dir):
    """Columns that are left without the empty and the one-level ones, with their number of values."""
    quantity = F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        quantity.alias("quantity"), F.when(quantity < 0, F.col("l_tax")).alias("blank"),
        F.col("l_linestatus").alias("two_levels"), F.when(quantity > 10, "only").alias("one_level"),
    )
    (left,) = drop_degenerate(lines)
    return left.agg(*[F.count(c).alias(c) for c in left.columns]).unpivot([], left.columns, "column_name", "n")


@query("negated", with_tables("""
SELECT coalesce(place NOT IN ('NATION_1', 'NATION_2'), true) AS is_outside,
       coalesce(NOT contains(place, '_1'), true) AS is_without, count(*) AS n
FROM (SELECT CASE WHEN year <> 1996 THEN country END AS place FROM student) GROUP BY ALL
""", STUDENTS_SQL))
def negated(spark, sf_dir):
    """Negated membership and text predicates keep rows without a value."""
    place = F.when(F.col("year") != 1996, F.col("country"))
    return students(spark, sf_dir).select(
        outside(place, ["NATION_1", "NATION_2"]).alias("is_outside"), without_text(place, "_1").alias("is_without")
    ).groupBy("is_outside", "is_without").agg(F.count(F.lit(1)).alias("n"))


_ACCOUNTS = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("balance", T.DoubleType())])


@query("csv_problems", """
WITH d AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN 'short' WHEN c_custkey % 13 = 0 THEN 'long' WHEN c_custkey % 7 = 0 THEN 'value' ELSE 'good' END AS kind FROM customer)
SELECT 'rows' AS item, count(*) AS n, sum(key)::BIGINT AS keys FROM d
UNION ALL SELECT 'balances', count(*), sum(key)::BIGINT FROM d WHERE kind IN ('good', 'long')
UNION ALL SELECT 'problems of a row', count(*), NULL FROM d WHERE kind IN ('short', 'long')
UNION ALL SELECT 'problems of balance', count(*), NULL FROM d WHERE kind = 'value'
""")
def csv_problems(spark, sf_dir):
    """Customers written as CSV with damaged rows and numbers, read back with a table of problems."""
    key = F.col("c_custkey")
    line = (F.when(key % 11 == 0, F.format_string('%d,"A, B"', key)).when(key % 13 == 0, F.format_string('%d,"A, B",%.2f,more', key, F.col("c_acctbal")))
            .when(key % 7 == 0, F.format_string('%d,"A, B",1.2.3', key)).otherwise(F.format_string('%d,"A, B",%.2f', key, F.col("c_acctbal"))))
    path = new_path(spark, "csv-")
    # every file starts with the header, as the CSV writer would have it
    table(spark, sf_dir, "customer").select(line.cast("string").alias("key,name,balance")).write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    rows, problems = read_csv_with_problems(spark, path, _ACCOUNTS)
    kinds = rows.agg(F.array(
        F.struct(F.lit("rows").alias("item"), F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys")),
        F.struct(F.lit("balances").alias("item"), F.count("balance").alias("n"), F.sum(F.when(F.col("balance").isNotNull(), F.col("key"))).alias("keys"))).alias("of"))
    of_column = F.when(F.col("column_name").isNull(), "problems of a row").otherwise(F.concat(F.lit("problems of "), "column_name"))
    counted = problems.groupBy(of_column.alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return append_rows(kinds.select(F.inline("of")), counted)
