"""Scratch space shared by driver and executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the session names, or the one set on its context."""
    return spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the application's own folder in the checkpoint folder.

    That folder belongs to the application: it is removed when the application ends.
    """
    root = checkpoint_root(spark)
    if not root:
        raise ValueError(
            f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share"
        )
    own = f"{root.rstrip('/')}/queryscore-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to scratch and read it back: computed once, lineage cut, loss-proof."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
