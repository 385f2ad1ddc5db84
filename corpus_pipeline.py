"""A training corpus from ``documents``: quality, near duplicates, repeated passages, benchmark leaks, packing.

``STAGES`` lists the stages in order. Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import op02_decontamination, op06_packing, op07_suffix, op08_jaccard, op09_quality
from wattframe.llm.queries import vocabulary
from wattframe.llm.texts import small_batches
from wattframe.operators.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The labels are those of the corpus."""
    return op09_quality.of_quality(small_batches(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    return op08_jaccard.one_of_each(small_batches(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 200 bytes that occurs more than once goes; the documents stay."""
    return op07_suffix.cut_texts(small_batches(docs), 200)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, also edited, go."""
    return op02_decontamination.without_leaks(small_batches(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, each with its place in a sequence of at most 4096 tokens."""
    return op06_packing.packed_documents(small_batches(docs), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: The stages are not expressible in SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
