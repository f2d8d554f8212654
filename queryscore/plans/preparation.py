"""From question records to filtered questions and training corpora."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from queryscore.operators.corpus import agentic_trajectories, mix_corpora, sft_examples, synth_to_sft
from queryscore.operators.execution import gold_filter
from queryscore.operators.filters import filter_difficulty
from queryscore.scratch import materialise
from queryscore.sources.database import (
    COLUMNS_SCHEMA, SAMPLES_SCHEMA, catalog_rows, describe_tables, register_database, sample_rows_of, schema_text,
)


def usable_questions(
    spark: SparkSession, questions: DataFrame, databases: DataFrame,
    difficulties: Iterable[str] | None = None, **limits,
) -> DataFrame:
    """Questions of the wanted difficulties with a verdict (keep, reason) on their gold query."""
    wanted = filter_difficulty(questions, difficulties)
    return materialise(gold_filter(spark, wanted, databases, **limits), "gold")


def open_databases(spark: SparkSession, dirs: dict[str, str], concurrency: int = 8) -> tuple[DataFrame, DataFrame]:
    """(schema catalog, table descriptions) of the databases in ``dirs``; none of them gives empty tables.

    Several databases are opened at a time, each in a session of its own. The driver gathers one row
    per column and one per table, whatever their number of databases: no plan grows with it.
    """
    def opened(item: tuple[str, str]) -> tuple[list[tuple], list[tuple]]:
        db_id, path = item
        tables = register_database(spark.newSession(), path)
        return catalog_rows({db_id: tables}), sample_rows_of(db_id, tables)

    columns, samples = [], []
    with ThreadPoolExecutor(concurrency) as pool:
        for some_columns, some_samples in pool.map(opened, dirs.items()):
            columns += some_columns
            samples += some_samples
    catalog = spark.createDataFrame(columns, COLUMNS_SCHEMA)
    return catalog, describe_tables(catalog, spark.createDataFrame(samples, SAMPLES_SCHEMA))


def training_corpus(
    questions: DataFrame, databases: DataFrame, columns: DataFrame, descriptions: DataFrame,
    synth: DataFrame | None = None, synth_schemas: DataFrame | None = None,
) -> DataFrame:
    """(source, messages): gold, agentic and, if given, synthetic examples."""
    extra = None if synth is None else synth_to_sft(synth, synth_schemas)
    return mix_corpora(
        gold=sft_examples(questions, schema_text(columns), databases),
        agentic=agentic_trajectories(questions, databases, columns, descriptions),
        synth=extra,
    )
