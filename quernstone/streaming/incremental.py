"""Resumable labelling: candidate files come in as a stream, each batch's open pairs are labelled once and appended.

Structured Streaming keeps which files are done in its checkpoint; the anti-join with the labels so far makes a batch that
is run again after a failure add nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEYS = ["spec", "nom"]


def label_stream(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, label: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> StreamingQuery:
    """Labels each new Parquet file of source once; label adds the column 'label' to a batch of pairs."""
    keys = keys or KEYS

    def batch(df: DataFrame, _: int) -> None:
        todo = df.dropDuplicates(keys)
        try:
            todo = todo.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        except Exception as e:  # no label yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        label(todo).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(labels: DataFrame) -> DataFrame:
    """Pairs and matches so far, by label."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))
