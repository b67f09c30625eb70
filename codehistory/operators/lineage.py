"""Cutting the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on this machine alone may be without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when what they were for is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if usual is None else spark.conf.set(key, usual)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written here and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder in spark.checkpoint.dir and read back.

    Like a reliable checkpoint it outlives executors, but the plan runs once and the columns
    stay compressed.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/history-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
