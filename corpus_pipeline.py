"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queryscore.llm import decontaminate, mixture, near_dedup, pii, quality_fm
from queryscore.llm.scratch import Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return near_dedup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, numbered by the column copy."""
    return mixture.emit(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
    ("masked", masked), ("mixed", mixed),
]
#: Two stages learn from labels or sample by hashes, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents of ``sf_dir``; an empty table passes through all of them.

    A stage's table is deleted when the next one is written.
    """
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for name, stage in STAGES:
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir), name)
        tables.free(before)
    return docs


pipeline = run
