"""Intermediate tables in the folder that every executor shares.

``settle`` writes a frame as Parquet and reads it back. That cuts the lineage in a way
that outlives lost executors, keeps column pruning and filter pushdown for later reads,
and gives Spark the real size of the data: a small settled table is broadcast by Spark's
own size check, a large one is shuffled.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only for a local master without it."""
    context = spark.sparkContext
    folder = spark.conf.get(_KEY, None) or context.getConf().get(_KEY) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="weighbridge-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/settled-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path not used before, among this application's tables."""
    return f"{_own_folder(spark)}/{name}{uuid.uuid4().hex}"


def _table_prefix(spark: SparkSession) -> str:
    return "settled_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


def release(spark: SparkSession) -> None:
    """Delete everything this application has settled. Frames read from it are invalid afterwards."""
    for found in spark.catalog.listTables(pattern=f"{_table_prefix(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS `{found.name}`")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[SparkSession]:
    """``with scratch(spark):`` releases the settled tables at the end of the block."""
    try:
        yield spark
    finally:
        release(spark)


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries in the block are deleted as each ends, not when the driver next collects its garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def settle(df: DataFrame, partition_by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table; the shuffles that made it are deleted."""
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write.partitionBy(*partition_by)
    with _freed(spark):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, hottest: float = 4.0) -> DataFrame:
    """``settle`` in ``buckets`` buckets by ``keys``, one sorted file each, known to the session's catalog.

    Tables with the same number of buckets join and group on ``keys`` without a shuffle, as often as they are read.
    A bucket is read by one task and cannot be split, so the buckets' rows are counted first (one pass over the
    keys): where one holds more than ``hottest`` times the average, the table is written by ``settle`` instead, and
    its joins shuffle, which adaptive execution can split. Rows are the same either way.
    """
    spark = df.sparkSession
    sizes = df.groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    if rows and largest > hottest * rows / buckets:
        return settle(df)
    name = _table_prefix(spark) + uuid.uuid4().hex
    parts = df.repartition(buckets, *keys)  # rows of a bucket in one task: one file per bucket
    parts.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)
