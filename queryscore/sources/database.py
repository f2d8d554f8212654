"""Databases as directories of Parquet tables, and their schema catalog."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore import fixed_values as fv
from queryscore.functions.sql_text import cap_cell, row_text
from queryscore.operators.skew import left_join_skewed

COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("db_id", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
    ]
)


def _list_dir(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is directory) of the entries of a directory on any file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    return [
        (s.getPath().getName(), s.getPath().toString(), s.isDirectory())
        for s in fs.listStatus(hadoop_path)
    ]


def file_versions(spark: SparkSession, path: str) -> str | None:
    """Names, sizes and times of all files below a directory, as text; None where it cannot be listed."""
    jvm = spark.sparkContext._jvm
    found = []
    try:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listFiles(hadoop_path, True)
        while files.hasNext():
            status = files.next()
            found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    except Py4JJavaError:
        return None
    return "\n".join(sorted(found))


def _holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a directory has Parquet files, directly or in its partition directories."""
    for name, full, is_dir in _list_dir(spark, path):
        if not is_dir and name.endswith(".parquet"):
            return True
        if is_dir and "=" in name and _holds_parquet(spark, full):
            return True
    return False


def database_tables(spark: SparkSession, path: str) -> dict[str, str]:
    """Table name → path: every ``name.parquet`` entry and every subdirectory of Parquet files."""
    tables = {}
    for name, full, is_dir in _list_dir(spark, path):
        if name.startswith((".", "_")):
            continue
        if name.endswith(".parquet"):
            tables[name[: -len(".parquet")]] = full
        elif is_dir and _holds_parquet(spark, full):
            tables[name] = full
    return dict(sorted(tables.items()))


def register_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Make the tables under ``path`` queryable by name in ``spark``.

    Databases may share table names: give each its own ``spark.newSession()``. A table
    whose schema cannot be read is left out.
    """

    def opened(full: str) -> DataFrame | None:
        try:
            return spark.read.parquet(full)
        except (PySparkException, Py4JJavaError):
            return None

    paths = database_tables(spark, path)
    # Reading a schema waits for storage, not for the CPU: look at several tables at once.
    with ThreadPoolExecutor(8) as pool:
        found = dict(zip(paths, pool.map(opened, paths.values())))
    tables = {name: df for name, df in found.items() if df is not None}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"`{name}`")
    return tables


def find_databases(spark: SparkSession, root: str) -> DataFrame:
    """(db_id, dir) of every database directory under ``root``."""
    rows = [(name, full) for name, full, is_dir in _list_dir(spark, root) if is_dir]
    return spark.createDataFrame(rows, "db_id string, dir string")


def catalog_rows(databases: dict[str, dict[str, DataFrame]]) -> list[tuple]:
    """(db_id, table_name, pos, column_name, type) of all columns of registered databases."""
    return [
        (db_id, table, pos, field.name, field.dataType.simpleString().upper())
        for db_id, tables in databases.items()
        for table, df in tables.items()
        for pos, field in enumerate(df.schema.fields)
    ]


def columns_catalog(spark: SparkSession, databases: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """The schema catalog of registered databases, one row per column."""
    return spark.createDataFrame(catalog_rows(databases), COLUMNS_SCHEMA)


def _table_lines(columns: DataFrame, line: Column) -> DataFrame:
    """One text per table: its columns in order, as ``name type`` joined by commas."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return columns.groupBy("db_id", "table_name").agg(
        F.array_join(ordered.getField("line"), ", ").alias("columns")
    )


def schema_text(columns: DataFrame) -> DataFrame:
    """(db_id, schema): one CREATE TABLE per table, by table name."""
    per_table = _table_lines(columns, F.concat_ws(" ", "column_name", "type"))
    ddl = F.concat(
        F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" ("), F.col("columns"), F.lit(")")
    )
    ordered = F.sort_array(F.collect_list(F.struct("table_name", ddl.alias("ddl"))))
    return per_table.groupBy("db_id").agg(
        F.array_join(ordered.getField("ddl"), "\n").alias("schema")
    )


def list_tables(columns: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """(db_id, tables, text): the tables of every database by name.

    With ``databases`` also those without tables, whose text says so.
    """
    listed = columns.groupBy("db_id").agg(F.sort_array(F.collect_set("table_name")).alias("tables"))
    if databases is not None:
        none = F.array().cast("array<string>")
        listed = databases.select("db_id").distinct().join(listed, "db_id", "left").withColumn(
            "tables", F.coalesce("tables", none)
        )
    some = F.concat(F.lit("Tables: "), F.array_join("tables", ", "))
    return listed.withColumn("text", F.when(F.size("tables") > 0, some).otherwise(fv.NO_TABLES))


SAMPLES_SCHEMA = "db_id string, table_name string, sample string"


def sample_rows_of(
    db_id: str,
    tables: dict[str, DataFrame],
    sample_rows: int = fv.SAMPLE_ROWS,
    max_cell: int = fv.CELL_CHARS,
    order_by: dict[str, list[str]] | None = None,
) -> list[tuple]:
    """(db_id, table_name, sample): the first rows of every table as display text.

    A few rows per table come to the driver: a limit at the top of a plan reads only as
    many partitions as it needs, one inside a larger plan would start a task on each.
    ``order_by`` names key columns that make "first" definite. A table that cannot be
    read has a null sample.
    """

    def sample(item: tuple[str, DataFrame]) -> tuple[str, str, str | None]:
        name, df = item
        keys = (order_by or {}).get(name)
        rows = df.orderBy(*keys) if keys else df
        cells = [cap_cell(F.col(f"`{c}`"), max_cell) for c in df.columns]
        try:
            lines = rows.select(row_text(cells).alias("line")).limit(sample_rows).collect()
        except (PySparkException, Py4JJavaError):
            return db_id, name, None
        return db_id, name, "\n".join(r.line for r in lines)

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(sample, tables.items()))


def table_samples(spark: SparkSession, db_id: str, tables: dict[str, DataFrame], **options) -> DataFrame:
    """``sample_rows_of`` one database as a table."""
    return spark.createDataFrame(sample_rows_of(db_id, tables, **options), SAMPLES_SCHEMA)


def describe_tables(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """(db_id, table_name, text): column list and sample rows of every table."""
    header = _table_lines(columns, F.concat_ws(" ", "column_name", "type"))
    return header.join(samples, ["db_id", "table_name"], "left").select(
        "db_id",
        "table_name",
        F.concat(
            F.lit("Table "), F.col("table_name"), F.lit(":\ncolumns: "), F.col("columns"),
            F.lit("\nsample:\n"), F.coalesce("sample", F.lit("(unavailable)")),
        ).alias("text"),
    )


def describe_requests(requests: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Answer (…, db_id, table_name) requests; unknown names get an error text.

    Names match exactly, so text that is not a table name never reaches SQL.
    """
    known = descriptions.select("db_id", "table_name", "text")
    return left_join_skewed(requests, known, ["db_id", "table_name"]).withColumn(
        "text",
        F.coalesce("text", F.concat(F.lit("Error: no such table: "), F.col("table_name"))),
    )
