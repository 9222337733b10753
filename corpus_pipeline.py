"""A cleaning pipeline over ``documents``: each stage works on what the one before kept.

1. quality: documents that the classifier rejects (score below 0.3) go;
2. near duplicates: one document of each group stays (5-word shingles, similarity 0.8);
3. repeated passages: later copies of byte strings of REPEAT_BYTES bytes are cut, the first stays;
4. decontamination: documents that hold a benchmark item go;
5. pieces: the texts that remain, as SentencePiece ids.

Rows without doc_id pass through every stage but the last on their text alone; rows that repeat
a doc_id are judged alike. Stages keep all columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.llm import decontaminate, near_dedup, pieces, quality, repeats
from weighbridge.sources import settle

QUALITY_THRESHOLD = 0.3
REPEAT_BYTES = 200  # a passage of some 50 words has 250 bytes or more


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least QUALITY_THRESHOLD; the classifier learns from all labels."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    groups = near_dedup.near_duplicates(docs)
    gone = groups.filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated passages; n_chars follows the text."""
    cut = repeats.remove_repeats(docs, REPEAT_BYTES)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of its pieces."""
    return pieces.encode(docs, pieces.load()).select("doc_id", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

# the classifier, sketches and Viterbi search have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
