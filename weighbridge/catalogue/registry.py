"""Where the questions and their checking SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Queries that no SQL can check
UNCHECKED: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def unchecked(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        UNCHECKED[name] = fn
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles half to even: the last bits depend on the order of summation."""
    return df.select(*[
        F.bround(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])
