"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept, as it was written, so that a stage that
fails or is changed can be run again alone and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlift.llm.common import read_table, written
from feedlift.llm.decontaminate import clean_stage
from feedlift.llm.line_dedup import dedup_stage
from feedlift.llm.packing import pack_stage
from feedlift.llm.quality import quality_stage
from feedlift.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_stage(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier elsewhere; none is dropped."""
    return dedup_stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links, that of the smallest id."""
    return keep_one(spark, docs, sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_stage(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids, in place of documents."""
    return pack_stage(spark, docs, sf_dir)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("simhash", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

# Classifier, SimHash and tokenizer are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
