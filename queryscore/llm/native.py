"""Column helpers for operators that stay inside Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def removed(text: Column, chars: str, by: str = "") -> Column:
    """``text`` with each of some characters replaced: one plain scan each, no regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words(text: Column) -> Column:
    """The words of a text; a null or blank text has none."""
    spaced = removed(F.coalesce(text, F.lit("")), GAP_CHARS[1:], " ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def free_name(columns: list[str], name: str = "_text") -> str:
    """``name``, longer by underscores where a column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def total(values: Column) -> Column:
    """The sum of an array of integers, 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row per id: of contradicting rows the larger label counts, nulls none."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
