"""One query for each operation of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import op01_language, op02_decontamination, op03_forest, op04_html, op05_sharding, op06_packing, op07_suffix, op08_jaccard, op09_quality
from wattframe.llm import op10_binary as op10_binary_
from wattframe.llm.texts import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_language.identified(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_forest.nearest(_table(spark, sf_dir, "embeddings"), 20, 20)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_html.extracted(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_sharding.sharded(_table(spark, sf_dir, "documents"), 40)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_suffix.without_repeats(_table(spark, sf_dir, "documents"), 200)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_jaccard.near_duplicates(_table(spark, sf_dir, "documents"), 3, 9, 10)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_binary_.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_language, op2_decontamination, op3_forest, op4_html, op5_sharding, op6_packing, op7_suffix, op8_jaccard, op9_quality, op10_binary)}
ORACLE_SQL: dict[str, str] = {}
