"""Question, schema, synthetic-record and result files, and the JSONL sink.

All readers use fixed schemas. ``pos`` orders records as the input does, over all its files, so
"first" and "last" stay meaningful on any number of tasks; ``numbered`` turns it into a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore.sources.json_array import elements

_STRICT = {"mode": "FAILFAST"}


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


QUESTION_FIELDS = _strings("db_id", "question", "evidence", "SQL", "query", "gold_sql", "difficulty")
SYNTH_FIELDS = _strings("db_id", "sql_complexity", "question", "external_knowledge", "cot", "sql")
DDL_FIELDS = T.StructType(
    [T.StructField("db_id", T.StringType()), T.StructField("ddls", T.ArrayType(T.StringType()))]
)
BREAKDOWN = T.StructType(
    [
        T.StructField("valid_sql", T.BooleanType()),
        T.StructField("ex", T.IntegerType()),
        T.StructField("syntax", T.DoubleType()),
        T.StructField("schema", T.DoubleType()),
        T.StructField("ngram", T.DoubleType()),
        T.StructField("format", T.DoubleType()),
        T.StructField("called_describe", T.BooleanType()),
        T.StructField("executable", T.BooleanType()),
        T.StructField("ex_fallback", T.IntegerType()),
        T.StructField("fallback_sql", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
RESULT_FIELDS = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("final_sql", T.StringType()),
        T.StructField("ex", T.IntegerType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("breakdown", BREAKDOWN),
        T.StructField("turns", T.IntegerType()),
        T.StructField("finished", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def _placed(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``pos``, which sorts like their place in the input: (file, split, line).

    One scan and no exchange. Lines of one split are read by one task in order.
    """
    kept = lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")
    ).filter(F.trim("value") != "")
    place = F.struct(
        F.col("_file").alias("file"), F.col("_split").alias("split"), F.monotonically_increasing_id().alias("line")
    )
    return kept.select(place.alias("pos"), "value")


def numbered(records: DataFrame, name: str) -> DataFrame:
    """``pos`` replaced by the 0-based number ``name`` of each record over all files.

    Reads the input a second time to count the records of each split. What is joined back has one
    row per split, so it is broadcast and the records stay where they are.
    """
    per_split = records.select("pos.file", "pos.split", "pos.line").groupBy("file", "split").agg(
        F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_split.select(
        F.col("file").alias("_file"), F.col("split").alias("_split"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    same = (F.col("pos.file") == F.col("_file")) & (F.col("pos.split") == F.col("_split"))
    number = F.col("_start") + F.col("pos.line") - F.col("_first")
    rest = [c for c in records.columns if c != "pos"]
    return records.join(F.broadcast(starts), same).select(number.alias(name), *rest)


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    return _placed(spark.read.text(path))


def _json_array_indented(spark: SparkSession, path: str, indent: int) -> DataFrame:
    """Records of one large, indented JSON array, read by as many tasks as it has splits.

    A line break never stands inside a JSON string, so a line that opens an object at the
    array's indent starts a record and nothing else does.
    """
    opening = "\n" + " " * indent + "{"
    chunks = spark.read.option("lineSep", opening).text(path)
    body = F.regexp_replace("value", r"\s*(?:,|\])?\s*\z", "")
    # What stands before the first record is only the opening bracket.
    records = chunks.withColumn("value", body).filter(F.trim("value") != "[")
    return _placed(records).withColumn("value", F.concat(F.lit("{"), "value"))


def _records(
    spark: SparkSession, path: str, fields: T.StructType, layout: str, indent: int = 2
) -> DataFrame:
    if layout == "jsonl":
        rows = _json_lines(spark, path)
    elif layout == "indented":
        rows = _json_array_indented(spark, path, indent)
    elif layout == "array":
        rows = elements(spark, path)
    else:
        raise ValueError(f"unknown layout {layout!r}: use jsonl, array or indented")
    return rows.select("pos", F.from_json("value", fields, _STRICT).alias("r")).select("pos", "r.*")


def _required(name: str) -> Column:
    return F.coalesce(name, F.raise_error(F.lit(f"record without {name}"))).alias(name)


def _or_empty(name: str) -> Column:
    return F.coalesce(name, F.lit("")).alias(name)


def read_questions(
    spark: SparkSession, path: str, db_root: str, layout: str = "jsonl", indent: int = 2,
) -> DataFrame:
    """(qid, db_id, question, gold_sql, db_path, evidence, difficulty).

    The gold query is the first non-empty of three known keys. ``qid`` is the number of the
    question in the input, from 0.
    """
    raw = numbered(_records(spark, path, QUESTION_FIELDS, layout, indent), "pos")
    gold = F.coalesce(*[F.nullif(k, F.lit("")) for k in ("SQL", "query", "gold_sql")], F.lit(""))
    return raw.select(
        F.col("pos").alias("qid"), _required("db_id"), _required("question"),
        gold.alias("gold_sql"), database_path(db_root, F.col("db_id")).alias("db_path"),
        _or_empty("evidence"), _or_empty("difficulty"),
    )


def database_path(db_root: str, db_id: Column) -> Column:
    """Directory of a database's tables."""
    return F.concat(F.lit(db_root.rstrip("/") + "/"), db_id)


def read_ddl(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """(db_id, schema): DDL statements joined by line breaks; the last record of a db wins."""
    raw = _records(spark, path, DDL_FIELDS, layout)
    return schema_from_ddls(raw)


def schema_from_ddls(ddls: DataFrame) -> DataFrame:
    """(pos, db_id, ddls) records to one schema text per database."""
    text = F.coalesce(F.array_join("ddls", "\n"), F.lit(""))
    return ddls.groupBy("db_id").agg(F.max_by(text, "pos").alias("schema"))


def read_synth(spark: SparkSession, path: str, layout: str = "jsonl", indent: int = 2) -> DataFrame:
    """(pos, db_id, sql_complexity, question, external_knowledge, cot, sql).

    All layouts split: ``jsonl``, ``array`` in any formatting, and ``indented``, which is cheaper than
    ``array`` for a pretty-printed one.
    """
    return _records(spark, path, SYNTH_FIELDS, layout, indent)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Scored results with ``ex_fallback`` lifted out of the breakdown."""
    raw = _records(spark, path, RESULT_FIELDS, "jsonl")
    return raw.withColumn("ex_fallback", F.coalesce("breakdown.ex_fallback", "ex"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, null fields included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
