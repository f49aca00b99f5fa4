"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again as the next one's input.

The stages keep the columns of ``documents`` (``doc_id``, ``text``, ``lang``, ``source``, ``n_chars``) but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decision_list, line_dedup, mixing, packing, simhash
from plenum.llm.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return decision_list.keep(docs, labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, exactly or nearly; those that lose all their lines with a word go."""
    counts = "__line_counts"
    done = line_dedup.dedup_lines(docs, counts).where(f"{counts}.n_removed = 0 or {counts}.n_left > 0")
    length = F.when(F.col(f"{counts}.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; SimHash fingerprints meet in BK-trees, similarity is verified."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed in sequences of 2048 ids."""
    return packing.op10(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("sequences", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
