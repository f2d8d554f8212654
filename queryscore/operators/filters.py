"""Question filters and lookups against the known databases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore.operators.skew import first_rows, left_join_skewed


def filter_difficulty(questions: DataFrame, difficulties: Iterable[str] | None = None) -> DataFrame:
    """Keep the named difficulties (a missing one counts as ""); None keeps all."""
    if difficulties is None:
        return questions
    return questions.filter(F.coalesce("difficulty", F.lit("")).isin(*difficulties))


def head_n(df: DataFrame, n: int, order_col: str | Column) -> DataFrame:
    """The first ``n`` rows by position; 0 keeps all."""
    return first_rows(df, n, order_col) if n else df


def usable(questions: DataFrame, databases: DataFrame) -> DataFrame:
    """Questions with a gold query and an existing database."""
    has_gold = F.coalesce("gold_sql", F.lit("")) != ""
    known = databases.select("db_id", F.lit(True).alias("_known")).distinct()
    return left_join_skewed(questions.filter(has_gold), known, ["db_id"]).filter("_known").select(*questions.columns)


def missing_databases(questions: DataFrame, databases: DataFrame) -> DataFrame:
    """Distinct ``db_id`` values without a database, sorted."""
    return (
        questions.select("db_id").distinct()
        .join(databases.select("db_id"), "db_id", "left_anti")
        .orderBy("db_id")
    )


