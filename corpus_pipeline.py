"""Training-data pipeline over documents: each stage works on all that the one before has kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name; what
each case gives is stated in the docstring of the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidlake.llm import decontam, exact_dedup, mixing, quality, simhash
from braidlake.llm.common import stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more); see quality.accepted."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id; see exact_dedup.keep_one."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; see simhash.keep_representatives."""
    return simhash.keep_representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: those of one hit word in 20 or more go, from others the passages are cut; see decontam.cleaned."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of sources, over the whole run; see mixing.mixed."""
    return mixing.mixed(docs, carry=True, whole=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed_sources),
]

#: The quality classifier is no SQL; tests/llm/test_web.py compares run() with plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
