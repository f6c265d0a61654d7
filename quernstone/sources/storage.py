"""Intermediate tables in the folder that all executors share. A stored table has neither lineage nor inherited size estimates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A single machine without one gets a temporary folder; a cluster must name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quernstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut; the size estimate of its plan stays, so loops use stored()."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder of stored tables. close() deletes it; what was not closed goes when the session ends."""

    def __init__(self, spark: SparkSession, name: str = "tables"):
        self.spark = spark
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.path)
        self.n = 0

    def store(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written and read again; in folders by the values of a column, if one is named."""
        at = f"{self.path}/{self.n}"
        self.n += 1
        (df.write.partitionBy(by) if by else df.write).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *numbers: int) -> None:
        """Deletes the tables of these numbers, of those stored so far the first being 0."""
        for k in numbers:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{k}"), True)

    def keep_last(self, last: int = 1) -> None:
        """Deletes all tables but the last one, or as many."""
        for k in range(self.n - last):
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{k}"), True)

    def close(self) -> None:
        self.fs.delete(self.path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to a table of its own in the shared folder and read again."""
    return Scratch(df.sparkSession).store(df)
