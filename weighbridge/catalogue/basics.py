"""Scans, audits, cleaning, scalar functions, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import SCORE_RANGE
from ..functions import (
    composite_key,
    fill_text,
    fixed_decimals,
    lower_label,
    plain_mean,
    safe_int_key,
    thousands,
    to_number,
    trim_blanks,
    truncate_label,
    weighted_mean,
)
from ..operators.grouped import equal_width_counts, row_counts
from ..operators.joins import contains_all, join_on, keep_matching, keep_unmatched, remove_rows
from ..operators.pick import groups_of_size, latest_one, latest_with_ties
from ..operators.quality import frequency_with_missing, key_audit, missingness
from ..operators.reshape import append_rows, distinct_rows, gather, spread, value_difference
from ..operators.rows import require, within
from ..plans.audit import entities_per_country, participation, score_summary, sector_conflicts
from ..plans.prepare import (
    add_average_score,
    attach_regions,
    clean_students,
    harmonise_country,
    relabel_sector,
    unmatched_countries,
)
from ..sources import first_rows, schema_profile, settle
from .registry import query, rounded
from .tables import (
    REGIONS_SQL,
    SCHOOLS_SQL,
    STUDENTS_SQL,
    regions,
    schools,
    students,
    table,
    with_country,
    with_tables,
)

SCORES = ("math", "read", "science")
RECODES = {"NATION_3": "NATION_4", "NATION_9": "NATION_4", "NATION_11": "NATION_1", "NATION_20": "NATION_X"}


@query("dim_scan_head", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 6")
def dim_scan_head(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("schema_profile", """
SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name,
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS column_type
FROM (DESCRIBE lineitem)
""")
def lineitem_schema(spark, sf_dir):
    return schema_profile(table(spark, sf_dir, "lineitem"))


@query("participation_full_join", """
SELECT coalesce(s.year, o.year) AS year, n_students, n_schools
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_students FROM lineitem GROUP BY 1) s
FULL JOIN (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_schools FROM orders GROUP BY 1) o
  ON s.year = o.year
""")
def participation_full_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"))
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return participation(lines, orders)


def _with_gaps(spark, sf_dir):
    """Lines with values blanked by rule, NaN included."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(line != 7, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).otherwise(F.lit(float("nan"))).alias("l_extendedprice"),
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"),
        F.when(line < 3, F.col("l_partkey")).alias("l_partkey"),
    )


@query("missingness", """
WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem)
SELECT variable, round_even(100.0 * cnt / n, 2) AS percent_missing FROM (
  SELECT 'l_orderkey' AS variable, 0 AS cnt
  UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_linenumber = 7
  UNION ALL SELECT 'l_extendedprice', count(*) FROM lineitem WHERE l_tax <= 0.01
  UNION ALL SELECT 'l_returnflag', count(*) FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT 'l_partkey', count(*) FROM lineitem WHERE l_linenumber >= 3) v, n
""")
def missing_profile(spark, sf_dir):
    return missingness(_with_gaps(spark, sf_dir))


@query("key_audit", """
SELECT count(*) AS n_rows,
       count(*) - count(DISTINCT coalesce(CAST(l_orderkey AS VARCHAR), 'NA') || '_' ||
                        coalesce(CAST(CASE WHEN l_linenumber < 7 THEN l_linenumber END AS VARCHAR), 'NA')) AS n_duplicated,
       count(*) FILTER (WHERE l_linenumber >= 7) AS n_key_missing
FROM lineitem
""")
def line_key_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("line")
    )
    return key_audit(lines, composite_key(F.col("l_orderkey"), F.col("line")), ["l_orderkey", "line"])


@query("freq_with_null", """
SELECT level AS l_returnflag, coalesce(n, 0) AS n FROM
  (SELECT DISTINCT l_returnflag AS level FROM lineitem UNION ALL SELECT NULL) v
  LEFT JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) c ON l_returnflag IS NOT DISTINCT FROM level
""")
def return_flag_frequency(spark, sf_dir):
    return frequency_with_missing(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("cleaning", with_tables("""
SELECT row_id, year, country, trim(gender, chr(9) || ' ') AS gender, escs, math, read, science
FROM student WHERE escs IS NOT NULL AND math BETWEEN 50 AND 1000 AND read BETWEEN 50 AND 1000
     AND science BETWEEN 50 AND 1000 AND gender IS NOT NULL
""", STUDENTS_SQL))
def cleaning(spark, sf_dir):
    rows = clean_students(students(spark, sf_dir, background=True), SCORES, SCORE_RANGE)
    return rows.select("row_id", "year", "country", trim_blanks(F.col("gender")).alias("gender"), "escs", *SCORES)


@query("score_summary", with_tables("""
, clean AS (SELECT math, read, science FROM student WHERE math BETWEEN 50 AND 1000 AND read BETWEEN 50 AND 1000
            AND science BETWEEN 50 AND 1000),
tagged AS (SELECT 'before' AS stage, math, read, science FROM student
           UNION ALL SELECT 'after', math, read, science FROM clean),
long AS (SELECT stage, 'math' AS subject, math AS v FROM tagged UNION ALL SELECT stage, 'read', read FROM tagged
         UNION ALL SELECT stage, 'science', science FROM tagged),
stats AS (SELECT stage, subject, min(v) AS a, quantile_cont(v, 0.25) AS b, quantile_cont(v, 0.5) AS c, avg(v) AS d,
                 quantile_cont(v, 0.75) AS e, max(v) AS f FROM long GROUP BY ALL),
cells AS (SELECT stage, subject, 'Min.' AS statistic, a AS v FROM stats UNION ALL SELECT stage, subject, '1st Qu.', b FROM stats
          UNION ALL SELECT stage, subject, 'Median', c FROM stats UNION ALL SELECT stage, subject, 'Mean', d FROM stats
          UNION ALL SELECT stage, subject, '3rd Qu.', e FROM stats UNION ALL SELECT stage, subject, 'Max.', f FROM stats)
SELECT stage, statistic, round_even(max(CASE WHEN subject = 'math' THEN v END), 4) AS math,
       round_even(max(CASE WHEN subject = 'read' THEN v END), 4) AS read,
       round_even(max(CASE WHEN subject = 'science' THEN v END), 4) AS science
FROM cells GROUP BY stage, statistic
""", STUDENTS_SQL))
def summary_before_after(spark, sf_dir):
    before = students(spark, sf_dir).select(*SCORES)
    stages = {"before": before, "after": within(before, SCORES, *SCORE_RANGE)}
    tagged = settle(append_rows(*[df.withColumn("stage", F.lit(stage)) for stage, df in stages.items()]), ("stage",))
    return rounded(score_summary(tagged, SCORES, ["stage"]).select("stage", "statistic", *SCORES))


@query("country_harmonise", with_tables("""
, counted AS (
  SELECT CASE n_name WHEN 'NATION_3' THEN 'NATION_4' WHEN 'NATION_9' THEN 'NATION_4' WHEN 'NATION_11' THEN 'NATION_1'
              WHEN 'NATION_20' THEN 'NATION_X' ELSE n_name END AS country, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT country, n, ilo_subregion, coalesce(country_name, country) AS country_name, world_bank_income_group
FROM counted LEFT JOIN region_income USING (country)
""", REGIONS_SQL))
def country_harmonise(spark, sf_dir):
    rows = _messy_country(spark, sf_dir)
    counts = row_counts(harmonise_country(rows, RECODES), ["country"])
    return attach_regions(counts, regions(spark, sf_dir))


def _messy_country(spark, sf_dir):
    """Country codes in lower case, padded with a space and a tab."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey")
    named = with_country(lines, spark, sf_dir)
    return named.select(F.concat(F.lit(" "), F.lower("country"), F.lit("\t")).alias("country"))


@query("unmatched_countries", """
SELECT 'NATION_X' AS country, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_20' HAVING count(*) > 0
""")
def unmatched(spark, sf_dir):
    return unmatched_countries(harmonise_country(_messy_country(spark, sf_dir), RECODES), regions(spark, sf_dir))


@query("safe_int_key", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN CAST(l_suppkey AS VARCHAR) END AS key
FROM lineitem
""")
def padded_keys(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") < 6, F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).when(
        F.col("l_linenumber") == 6, F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))
    ).otherwise(F.concat(F.lit("99999999"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", safe_int_key(raw).alias("key"))


@query("composite_key", """
SELECT l_returnflag || '_' || coalesce(CAST(CASE WHEN l_linenumber < 5 THEN l_linenumber END AS VARCHAR), 'NA')
       || '_' || CAST(l_suppkey AS VARCHAR) AS key, count(*) AS n
FROM lineitem GROUP BY 1
""")
def composite_keys(spark, sf_dir):
    key = composite_key(
        F.col("l_returnflag"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber")), F.col("l_suppkey")
    )
    return row_counts(table(spark, sf_dir, "lineitem").select(key.alias("key")), ["key"])


@query("truncate_label", """
SELECT p_partkey, CASE WHEN length(label) > 22 THEN left(label, 19) || '...' ELSE label END AS label
FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS label FROM part)
""")
def part_labels(spark, sf_dir):
    label = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", truncate_label(label, 22).alias("label"))


@query("thousands", """
SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' ') AS price FROM orders
""")
def thousands_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", thousands(F.floor("o_totalprice")).alias("price"))


@query("fixed_decimals", """
SELECT o_orderkey, printf('%.3f', round_even(o_totalprice / 7, 3)) AS price FROM orders
""")
def fixed_decimals_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fixed_decimals(F.col("o_totalprice") / 7, 3).alias("price")
    )


@query("text_to_number", """
SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_number,
       CAST(NULL AS DOUBLE) AS no_number
FROM part
""")
def text_to_number(spark, sf_dir):
    brand = F.regexp_replace("p_brand", "Brand#", "")
    return table(spark, sf_dir, "part").select(
        "p_partkey", to_number(brand).alias("brand_number"), to_number(F.col("p_brand")).alias("no_number")
    )


@query("lower_label", with_tables("""
SELECT lower(trim(gender, chr(9) || ' ')) AS gender, count(*) AS n FROM student GROUP BY 1
""", STUDENTS_SQL))
def gender_labels(spark, sf_dir):
    return row_counts(students(spark, sf_dir).select(lower_label(F.col("gender")).alias("gender")), ["gender"])


@query("name_fallback", with_tables("""
SELECT country, coalesce(nullif(CASE WHEN country = 'NATION_5' THEN 'NA' ELSE country_name END, 'NA'), country) AS label
FROM region_income
""", REGIONS_SQL))
def name_fallback(spark, sf_dir):
    name = F.when(F.col("country") == "NATION_5", "NA").otherwise(F.col("country_name"))
    return regions(spark, sf_dir).select("country", fill_text(name, F.col("country")).alias("label"))


@query("entities_per_country", with_tables("""
SELECT coalesce(country_name, country) AS country_name, count(DISTINCT student_id) AS n_students
FROM student LEFT JOIN region_income USING (country) GROUP BY 1
""", STUDENTS_SQL, REGIONS_SQL))
def students_per_country(spark, sf_dir):
    return entities_per_country(students(spark, sf_dir), regions(spark, sf_dir), ["student_id"], "n_students")


@query("schools_per_country", with_tables("""
SELECT coalesce(country_name, country) AS country_name, count(DISTINCT (year, school_id)) AS n_schools
FROM student LEFT JOIN region_income USING (country) GROUP BY 1
""", STUDENTS_SQL, REGIONS_SQL))
def schools_per_country(spark, sf_dir):
    return entities_per_country(
        students(spark, sf_dir), regions(spark, sf_dir), ["year", "school_id"], "n_schools", width=22
    )


@query("sector_audit", with_tables("""
SELECT 'private above 80' AS "check", count(*) AS n_cases FROM school WHERE fund_gov > 80 AND public_private = 'private'
UNION ALL SELECT 'public below 50', count(*) FROM school WHERE fund_gov < 50 AND public_private = 'public'
""", SCHOOLS_SQL))
def sector_audit(spark, sf_dir):
    return sector_conflicts(schools(spark, sf_dir))


@query("sector_relabel", with_tables("""
, labels AS (SELECT CASE WHEN fund_gov > 80 THEN 'public' WHEN fund_gov < 50 THEN 'private' ELSE public_private END
             AS public_private FROM school)
SELECT level AS public_private, coalesce(n, 0) AS n
FROM (SELECT DISTINCT public_private AS level FROM labels UNION SELECT NULL) v
LEFT JOIN (SELECT public_private, count(*) AS n FROM labels GROUP BY 1) c ON public_private IS NOT DISTINCT FROM level
""", SCHOOLS_SQL))
def sector_relabel(spark, sf_dir):
    return frequency_with_missing(relabel_sector(schools(spark, sf_dir)), "public_private")


@query("row_mean", with_tables("SELECT row_id, avg_score FROM student", STUDENTS_SQL))
def row_means(spark, sf_dir):
    return add_average_score(students(spark, sf_dir), SCORES).select("row_id", "avg_score")


@query("weighted_mean_global", with_tables("""
SELECT round_even(sum(avg_score * stu_wgt) / sum(CASE WHEN avg_score IS NOT NULL THEN stu_wgt END), 4) AS weighted_mean,
       CASE WHEN count(*) FILTER (WHERE stu_wgt IS NULL AND avg_score IS NOT NULL) = 0 THEN 1.0 END AS strict_share,
       count(*) AS n
FROM student
""", STUDENTS_SQL))
def weighted_mean_global(spark, sf_dir):
    score, weight = F.col("avg_score"), F.col("stu_wgt")
    return rounded(students(spark, sf_dir).agg(
        weighted_mean(score, weight, strict_weight=False).alias("weighted_mean"),
        # the strict mean of 1 is missing as soon as one row with a score lacks its weight
        weighted_mean(F.when(score.isNotNull(), F.lit(1.0)), weight).alias("strict_share"),
        F.count(F.lit(1)).alias("n"),
    ))


@query("grouped_mean", with_tables("""
SELECT country, year, round_even(avg(math), 4) AS mean_math FROM student GROUP BY ALL
""", STUDENTS_SQL))
def grouped_mean(spark, sf_dir):
    return rounded(students(spark, sf_dir).groupBy("country", "year").agg(plain_mean(F.col("math")).alias("mean_math")))


@query("histogram30", with_tables("""
, lim AS (SELECT min(avg_score) AS lo, max(avg_score) AS hi FROM student)
SELECT CAST(least(floor((avg_score - lo) * 30 / (hi - lo)) + 1, 30) AS INTEGER) AS bin, count(*) AS n
FROM student, lim GROUP BY 1
""", STUDENTS_SQL))
def histogram30(spark, sf_dir):
    return equal_width_counts(students(spark, sf_dir), "avg_score", 30)


@query("category_counts", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")
def category_counts(spark, sf_dir):
    return row_counts(table(spark, sf_dir, "lineitem"), ["l_linestatus"])



@query("semi", """
SELECT c_custkey, c_nationkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)
""")
def semi(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 480000)
    return keep_matching(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        dear.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], null_safe=False,
    )


@query("anti", """
SELECT c_custkey, c_nationkey FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)
""")
def anti(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 480000)
    return keep_unmatched(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        dear.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"],
    )


@query("anti_all_columns", """
SELECT l_orderkey, l_linenumber, flag FROM
  (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') AS flag FROM lineitem) a
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') AS flag FROM lineitem WHERE l_quantity > 25) b
  WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.flag IS NOT DISTINCT FROM b.flag)
""")
def anti_all_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    wanted = ["l_orderkey", "l_linenumber", "flag"]
    return remove_rows(lines.select(*wanted), lines.where(F.col("l_quantity") > 25).select(*wanted))


@query("containment", """
SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0 AS all_present,
       'orders of lines' AS test
UNION ALL
SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0, 'customers with orders'
""")
def containment(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return append_rows(
        contains_all(lines.select(F.col("l_orderkey").alias("o_orderkey")), orders, "o_orderkey")
        .withColumn("test", F.lit("orders of lines")),
        contains_all(customers, orders, "o_custkey").withColumn("test", F.lit("customers with orders")),
    )


@query("null_safe_join", """
SELECT flag, status, a.n AS n_lines, b.n AS n_orders
FROM (SELECT nullif(l_linestatus, 'F') AS flag, count(*) AS n FROM lineitem GROUP BY 1) a
LEFT JOIN (SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1) b
  ON flag IS NOT DISTINCT FROM status
""")
def null_safe_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.nullif("l_linestatus", F.lit("F")).alias("flag"))
    orders = table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("flag"))
    right = row_counts(orders, ["flag"], "n_orders").withColumn("status", F.col("flag"))
    return join_on(row_counts(lines, ["flag"], "n_lines"), right, ["flag"], "left", null_safe=True)


@query("distinct_codes", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_codes(spark, sf_dir):
    return distinct_rows(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("code_difference", """
SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def code_difference(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return value_difference(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")),
        urgent.select(F.col("o_custkey").alias("custkey")), "custkey",
    )


@query("append_rows", """
SELECT c_nationkey AS nationkey, max(c_acctbal) AS customer_balance, CAST(NULL AS DOUBLE) AS supplier_balance
FROM customer GROUP BY 1
UNION ALL SELECT s_nationkey, NULL, max(s_acctbal) FROM supplier GROUP BY 1
""")
def append_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey"))
    return append_rows(
        customers.agg(F.max("c_acctbal").alias("customer_balance")),
        suppliers.agg(F.max("s_acctbal").alias("supplier_balance")),
    )


@query("spread_gather", """
SELECT l_returnflag, 'status_' || s AS status, count(*) FILTER (WHERE l_linestatus = s) AS n
FROM lineitem, (VALUES ('F'), ('O')) v(s) GROUP BY ALL HAVING count(*) FILTER (WHERE l_linestatus = s) > 0
""")
def spread_gather(spark, sf_dir):
    counts = row_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    wide = spread(counts, "l_linestatus", ["F", "O"], "n", prefix="status_")
    return require(gather(wide, ["l_returnflag"], ["status_F", "status_O"], "status", "n"), "n")


@query("latest_with_ties", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY orders.o_orderdate DESC) = 1
""")
def newest_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = latest_with_ties(orders, ["o_custkey"], "o_orderdate")
    return newest.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("latest_one", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY orders.o_orderdate DESC, o_orderkey DESC) = 1
""")
def newest_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    newest = latest_one(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return newest.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("groups_of_size", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 2
""")
def two_line_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return groups_of_size(lines, ["l_orderkey"], 2)
