"""Survey tables derived from the TPC-H-like test tables, in Spark and in SQL.

Each shipped line plays a sampled student, each supplier a school, each nation a country.
Some values are blanked by rule because the test tables hold no NULLs. The SQL twins are
used by the result checks only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import composite_key, row_mean
from ..operators.joins import join_on, star


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. File footers are read for the schema once per session and table."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _text_key(*names: str) -> Column:
    return F.concat_ws("-", *[F.col(n).cast("string") for n in names])


def with_country(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the supplier's balance and country to rows that carry ``l_suppkey``."""
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"), "s_acctbal"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return star(df, (supplier, ["l_suppkey"]), (nation, ["n_nationkey"]), how="inner")


def _shipped_in(lines: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """Lines of the given cycles, as ranges of the stored column, so that the scan can skip the rest."""
    if years is None:
        return lines
    shipped, kind = F.col("l_shipdate"), lines.schema["l_shipdate"].dataType

    def start(year: int) -> Column:
        return F.lit(f"{year}-01-01").cast(kind)

    return lines.where(reduce(or_, [(shipped >= start(y)) & (shipped < start(y + 1)) for y in sorted(years)]))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    key = F.col("n_nationkey")
    return join_on(nation, table(spark, sf_dir, "region"), ["r_regionkey"], "inner").select(
        F.col("n_name").alias("country"),
        F.when(key != 7, F.concat(F.lit("Country "), key.cast("string"))).alias("country_name"),
        F.col("r_name").alias("ilo_subregion"),
        F.when(key < 5, "Low income")
        .when(key < 11, "Lower-middle income")
        .when(key < 17, "Upper-middle income")
        .when(key < 24, "High income")
        .alias("world_bank_income_group"),
    )


REGIONS_SQL = """
region_income AS (
  SELECT n_name AS country,
         CASE WHEN n_nationkey <> 7 THEN 'Country ' || n_nationkey END AS country_name,
         r_name AS ilo_subregion,
         CASE WHEN n_nationkey < 5 THEN 'Low income' WHEN n_nationkey < 11 THEN 'Lower-middle income'
              WHEN n_nationkey < 17 THEN 'Upper-middle income' WHEN n_nationkey < 24 THEN 'High income'
         END AS world_bank_income_group
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def students(
    spark: SparkSession, sf_dir: str, background: bool = False, years: Sequence[int] | None = None
) -> DataFrame:
    """One row per shipped line. ``escs`` needs two more joins, so it is optional.

    Values of a line are made before the joins and texts after them, so that a line moves once, by its order, as a few numbers.
    """
    year, price, quantity = F.year("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity")
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    df = _shipped_in(table(spark, sf_dir, "lineitem"), years).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus",
        year.alias("year"),
        (~((flag == "A") & (line == 7))).alias("has_background"),
        F.when(~((F.col("l_discount") == 0) & (line == 1)), price / 105).alias("math"),
        (price * (1 - F.col("l_discount")) / 105).alias("read"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 105).alias("science"),
        F.when(~((flag == "R") & (quantity == 1) & (year == 1997)), quantity).alias("stu_wgt"),
    ).withColumn("avg_score", row_mean(F.col("math"), F.col("read"), F.col("science")))
    if background:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")
        )
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
        balances = join_on(orders, customers, ["c_custkey"], "inner").select("l_orderkey", "c_acctbal")
        df = join_on(df, balances, ["l_orderkey"], "inner")
    return with_country(df, spark, sf_dir).select(
        _text_key("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        "year",
        "country",
        F.col("l_suppkey").cast("string").alias("school_id"),
        composite_key(F.col("country"), F.col("year"), F.col("l_suppkey")).alias("school_uid"),
        F.col("l_orderkey").cast("string").alias("student_id"),
        F.when(F.col("l_linestatus") == "F", " Female").otherwise("male\t").alias("gender"),
        *([F.when(F.col("has_background"), F.col("c_acctbal")).alias("escs")] if background else []),
        "math", "read", "science", "stu_wgt", "avg_score",
    )


STUDENTS_SQL = """
student_base AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS row_id,
         CAST(year(l_shipdate) AS INTEGER) AS year, n_name AS country,
         CAST(l_suppkey AS VARCHAR) AS school_id,
         n_name || '_' || year(l_shipdate) || '_' || l_suppkey AS school_uid,
         CAST(l_orderkey AS VARCHAR) AS student_id,
         CASE WHEN l_linestatus = 'F' THEN ' Female' ELSE 'male' || chr(9) END AS gender,
         CASE WHEN NOT (l_returnflag = 'A' AND l_linenumber = 7) THEN c_acctbal END AS escs,
         CASE WHEN NOT (l_discount = 0 AND l_linenumber = 1) THEN l_extendedprice / 105 END AS math,
         l_extendedprice * (1 - l_discount) / 105 AS read,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) / 105 AS science,
         CASE WHEN NOT (l_returnflag = 'R' AND l_quantity = 1 AND year(l_shipdate) = 1997)
              THEN l_quantity END AS stu_wgt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
student AS (
  SELECT *, (coalesce(math, 0) + coalesce(read, 0) + coalesce(science, 0))
            / (3 - CASE WHEN math IS NULL THEN 1 ELSE 0 END) AS avg_score
  FROM student_base)"""


def schools(spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None) -> DataFrame:
    """One row per supplier and year, summed from its lines before any join."""
    per_year = (
        _shipped_in(table(spark, sf_dir, "lineitem"), years)
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("school_size"),
            F.count_if(F.col("l_linestatus") == "F").cast("double").alias("enrol_girls"),
            F.count_if(F.col("l_linestatus") != "F").cast("double").alias("enrol_boys"),
            F.avg("l_quantity").alias("stratio"),
            F.avg("l_discount").alias("staff_shortage"),
        )
    )
    balance, year = F.col("s_acctbal"), F.col("year")
    return with_country(per_year, spark, sf_dir).select(
        "country",
        "year",
        F.col("l_suppkey").cast("string").alias("school_id"),
        composite_key(F.col("country"), year, F.col("l_suppkey")).alias("school_uid"),
        F.when((balance >= 0) & (balance + 500 * (year - 1998) < 4000), "private")
        .when(balance >= 0, "public")
        .alias("public_private"),
        ((balance + 1000) / 110).alias("fund_gov"),
        "stratio", "enrol_boys", "enrol_girls", "staff_shortage", "school_size",
    )


SCHOOLS_SQL = """
school AS (
  SELECT country, year, school_id, country || '_' || year || '_' || school_id AS school_uid,
         CASE WHEN s_acctbal >= 0 AND s_acctbal + 500 * (year - 1998) < 4000 THEN 'private'
              WHEN s_acctbal >= 0 THEN 'public' END AS public_private,
         (s_acctbal + 1000) / 110 AS fund_gov, stratio, enrol_boys, enrol_girls, staff_shortage, school_size
  FROM (SELECT n_name AS country, CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(l_suppkey AS VARCHAR) AS school_id, s_acctbal,
               CAST(count(*) AS DOUBLE) AS school_size,
               CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS enrol_girls,
               CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS DOUBLE) AS enrol_boys,
               avg(l_quantity) AS stratio, avg(l_discount) AS staff_shortage
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY ALL))"""


def _nation_orders(spark: SparkSession, sf_dir: str, *measures: Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Order measures per customer nation and order year, with the nation's name joined last."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    summed = (
        join_on(orders, customers, ["c_custkey"], "inner")
        .groupBy("n_nationkey", F.year("o_orderdate").alias("year"), *extra)
        .agg(*measures)
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return join_on(summed, nation, ["n_nationkey"], "inner")


def gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_nation = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        (F.avg("c_acctbal") * 10).alias("mean")
    )
    return join_on(per_nation, table(spark, sf_dir, "nation"), ["n_nationkey"], "inner").select(
        F.col("n_name").alias("country"),
        F.when(F.col("n_nationkey") != 3, F.col("mean")).alias("GDP_per_PPP_2022"),
    )


def expenditure(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ~((F.col("year") >= 2000) & F.col("n_nationkey").isin(2, 5, 12))
    return _nation_orders(spark, sf_dir, (F.avg("o_totalprice") / 50000).alias("share")).select(
        "country", "year", F.when(known, F.col("share")).alias("percentage_education_on_gdp")
    )


def gender_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("o_orderpriority") <= "2-HIGH", "Primary").otherwise("Secondary").alias("school_level")
    ratio = F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O"))
    return _nation_orders(spark, sf_dir, ratio.alias("gender_parity_index"), extra=(level,)).select(
        "country", "year", "school_level", "gender_parity_index"
    )


INDICATORS_SQL = """
gdp AS (
  SELECT n_name AS country, CASE WHEN n_nationkey <> 3 THEN avg(c_acctbal) * 10 END AS GDP_per_PPP_2022
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey),
expenditure AS (
  SELECT n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN NOT (year(o_orderdate) >= 2000 AND n_nationkey IN (2, 5, 12))
              THEN avg(o_totalprice) / 50000 END AS percentage_education_on_gdp
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, n_nationkey, year(o_orderdate)),
gender_index AS (
  SELECT n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN o_orderpriority <= '2-HIGH' THEN 'Primary' ELSE 'Secondary' END AS school_level,
         CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0
              THEN count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus = 'O')
         END AS gender_parity_index
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""


def with_tables(body: str, *ctes: str) -> str:
    return "WITH" + ",".join(ctes) + body
