"""Outcomes that outlive a job: a table keyed by what they depend on."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore.sources.database import file_versions

_VERSIONS = T.StructType([T.StructField("db_id", T.StringType()), T.StructField("version", T.StringType())])


class OutcomeStore:
    """A Parquet table of outcomes below ``path``, on storage that all jobs share.

    An outcome is known by the kind of run, the version of its database and the digest of its text.
    The version is a digest of the names, sizes and times of all files of the database, so any
    change of a table makes the outcomes of the whole database unknown. Jobs may add at the same
    time: files are appended by Spark's own commit, and of equal keys one is taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self.path = path

    def versions(self, databases: DataFrame) -> DataFrame:
        """(db_id, version) of the databases (db_id, dir); one that cannot be listed has none."""
        rows = databases.groupBy("db_id").agg(F.min("dir").alias("dir")).toLocalIterator()
        found = [(r.db_id, hashlib.sha256(files.encode()).hexdigest()) for r in rows if (files := file_versions(self._spark, r.dir)) is not None]
        return self._spark.createDataFrame(found, _VERSIONS)

    def _table(self, key: str) -> DataFrame | None:
        try:
            return self._spark.read.parquet(f"{self.path}/{key}")
        except AnalysisException:  # nothing was added yet
            return None

    def split(self, texts: DataFrame, versions: DataFrame, key: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
        """(texts without an outcome, outcomes of the others as ``schema``) of (db_id, sql, uses, dir)."""
        named = texts.join(versions, "db_id", "left").withColumn("digest", F.sha2(F.col("sql"), 256))
        table = self._table(key)
        if table is None:
            return texts, self._spark.createDataFrame([], schema)
        known = table.dropDuplicates(["version", "digest"]).drop("db_id", "sql")
        misses = named.join(known.select("version", "digest"), ["version", "digest"], "left_anti").select(*texts.columns)
        return misses, named.join(known, ["version", "digest"]).select(*schema.names)

    def add(self, outcomes: DataFrame, versions: DataFrame, key: str) -> None:
        named = outcomes.join(versions, "db_id").withColumn("digest", F.sha2(F.col("sql"), 256))
        named.write.mode("append").parquet(f"{self.path}/{key}")
