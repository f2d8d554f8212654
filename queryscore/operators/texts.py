"""SQL texts taken apart once each, however many rows share them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscore.functions.similarity import bigrams, jaccard, schema_items
from queryscore.operators.skew import left_join_skewed
from queryscore.scratch import materialise

_PARTS = {"items": schema_items, "grams": bigrams}


def text_parts(texts: DataFrame, parts: tuple[str, ...] = ("items", "grams")) -> DataFrame:
    """(text_id, parts …) of every distinct ``sql`` of ``texts``: schema items and token pairs."""
    named = texts.where("sql IS NOT NULL").groupBy(F.md5("sql").alias("text_id")).agg(F.first("sql").alias("sql"))
    return named.select("text_id", *[_PARTS[p](F.col("sql")).alias(p) for p in parts])


def with_parts(rows: DataFrame, columns: dict[str, str], parts: tuple[str, ...] = ("items", "grams")) -> DataFrame:
    """Add a struct of parts for each text column, named as ``columns`` (name → text column) says.

    ``rows`` is read once for the dictionary of its distinct texts and once for each join: materialise
    it first. Only ids are joined, no text is read again; a null text has null parts.
    """
    texts = reduce(DataFrame.unionByName, [rows.select(F.col(c).alias("sql")) for c in columns.values()])
    found = materialise(text_parts(texts, parts), "texts")
    for name, sql in columns.items():
        named = found.select("text_id", F.struct(*parts).alias(name))
        rows = left_join_skewed(rows.withColumn("text_id", F.md5(sql)), named, ["text_id"]).drop("text_id")
    return rows


def with_schema_link(rows: DataFrame, pred: str, gold: str, name: str = "schema_link") -> DataFrame:
    """Add the shared share of the schema items of two text columns."""
    known = with_parts(rows, {"_pred": pred, "_gold": gold}, ("items",))
    none = F.array().cast("array<string>")
    both = [F.coalesce(f"{side}.items", none) for side in ("_pred", "_gold")]
    return known.withColumn(name, jaccard(*both)).drop("_pred", "_gold")
