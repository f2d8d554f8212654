"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queryscore.scratch import scratch_dir


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    return scratch_dir(spark, purpose)


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back: it survives lost executors and is never computed twice."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables that are deleted before the application ends.

    ``free`` may be called once no later plan reads a table: what was made from it is written itself.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(self._spark, purpose)
        df.write.parquet(path)
        found = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(found)] = (found, path)
        return found

    def free(self, *tables: DataFrame) -> None:
        """Delete ``tables``, or all that are left."""
        for key in [id(t) for t in tables] or list(self._paths):
            _, path = self._paths.pop(key, (None, None))
            if path is not None:
                delete(self._spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
