"""Reading, peeking at and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row, checked against the declared schema; empty fields are NULL."""
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("nullValue", "NA")
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
        .select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name)
                  if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields])
    )


def read_csv_with_problems(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of CSV files that may be damaged; a damaged row or value does not end the job.

    rows: a value that is not of its declared type is NULL, and so are the fields that a short row lacks;
    surplus fields are left out. problems: file, row_text, column_name, expected, actual, one row per value
    of another type (``column_name`` set) and per row with too few or too many fields, as after a lost quote
    (``column_name`` NULL, ``row_text`` as in the file). Another header than the schema's still fails at once.
    """
    raw = "__raw"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(raw, T.StringType())])
    read = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", raw)
        .option("columnPruning", False)  # fields are counted even where a query needs few of them
        .schema(text)
        .csv(path)
    )
    fields = {f.name: F.nullif(F.col(f.name), F.lit("")) for f in schema.fields}
    typed = {f.name: fields[f.name] if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    rows = read.select(*[v.alias(name) for name, v in typed.items()])

    nothing = F.lit(None).cast("string")
    found = [F.when(F.col(raw).isNotNull(), F.struct(
        F.col(raw).alias("row_text"), nothing.alias("column_name"), F.lit(f"{len(schema.fields)} fields").alias("expected"), nothing.alias("actual")))]
    line = F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields]))
    found += [F.when(fields[f.name].isNotNull() & typed[f.name].isNull(), F.struct(
        F.coalesce(raw, line).alias("row_text"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("expected"), F.col(f.name).alias("actual")))
        for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    problems = read.select(F.col("_metadata.file_path").alias("file"), F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows, problems


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; with a schema, missing columns or other types fail at once."""
    df = spark.read.parquet(path)
    if schema is None:
        return df
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path}: missing or differently typed columns {wrong}")
    return df.select(*[f.name for f in schema.fields])


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a result table; CSV gets a header and doubles quotes inside quoted fields."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt}")
    writer = df.write.mode("errorifexists").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def first_rows(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """The first rows in a stated order (planned as a bounded top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(rows, "position INT, column_name STRING, column_type STRING")
