"""Aggregation and joins of streams with event time: windows, duplicates, interval joins, state of one's own, and runs over files that are there.

A stream tells with its watermark how late a row may come. Where a query appends, a window's row comes out once, when the watermark has passed
its end; rows that come after that are left out, and the state is dropped. Where a query gives complete tables, all
windows are held and nothing is ever late.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quernstone.sources.storage import Scratch


def tumbling(at: str, size: str) -> Column:
    return F.window(at, size)


def sliding(at: str, size: str, step: str) -> Column:
    return F.window(at, size, step)


def session(at: str, gap: str) -> Column:
    return F.session_window(at, gap)


def windowed(stream: DataFrame, at: str, windows: Column, keys: list[str], late: str, *aggregates: Column) -> DataFrame:
    """(start, end, keys, aggregates) of each window, with the watermark `late` behind the latest row."""
    found = stream.withWatermark(at, late).groupBy(windows.alias("w"), *keys).agg(*aggregates)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in found.columns if c != "w" and c not in keys])


def first_of_each(stream: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key to come; a key is remembered until the watermark passes its row's time and `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def within(left: DataFrame, right: DataFrame, key: str, at: str, before: str, after: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of two streams by key where right's time is from `before` earlier to `after` later than left's. Right's columns get the prefix "right_".

    Both sides wait for partners only as long as one can still come. An outer join gives a row without partner once none can.
    """
    a, b = left.withWatermark(at, late), right.withWatermark(at, late)
    b = b.select(*(F.col(c).alias(f"right_{c}") for c in b.columns))
    near = (F.col(f"right_{at}") >= F.col(at) - F.expr(f"INTERVAL {before}")) & (F.col(f"right_{at}") <= F.col(at) + F.expr(f"INTERVAL {after}"))
    return a.join(b, (F.col(key) == F.col(f"right_{key}")) & near, how)


def best_so_far(stream: DataFrame, key: str, at: str, value: str, tie: str, patience: int, late: str, forget: str = "30 days") -> DataFrame:
    """(key, at, tie, epoch, value, best, waited, stopped): of each row, the least value of its key until then, the rows since it, and whether these are `patience`.

    Rows of a key count in order of (at, tie) within a micro-batch. State is three numbers for each key; it is dropped when the watermark is `forget`
    past the key's last row.
    """
    types = dict(stream.dtypes)
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([at, tie], kind="stable")
        epoch, best, waited = state.get if state.exists else (0, float("inf"), 0)
        out = []
        for v in rows[value]:
            epoch, waited = epoch + 1, 0 if v < best else waited + 1
            best = min(best, v)
            out.append((epoch, best, waited, waited >= patience))
        state.update((epoch, best, waited))
        last = int(rows[at].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        more = pd.DataFrame(out, columns=["epoch", "best", "waited", "stopped"])
        yield pd.DataFrame({key: k[0], at: rows[at].to_numpy(), tie: rows[tie].to_numpy(), "epoch": more["epoch"], value: rows[value].to_numpy(), "best": more["best"], "waited": more["waited"], "stopped": more["stopped"]})

    ddl = f"{key} {types[key]}, {at} {types[at]}, {tie} {types[tie]}, epoch long, {value} double, best double, waited long, stopped boolean"
    rows = stream.where(F.col(value).isNotNull()).select(key, at, tie, F.col(value).cast("double").alias(value)).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(run, ddl, "epoch long, best double, waited long", "append", GroupStateTimeout.EventTimeTimeout)


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files: int | None = None) -> DataFrame:
    """The Parquet table of a folder as a stream of its files, `files` of them in a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{name}.parquet*")


@dataclass(frozen=True)
class Run:
    """The result table of a run; rows of state at the end of each micro-batch, and rows that were too late, all told."""

    table: DataFrame
    state: list[int]
    late: int


def run(stream: DataFrame, mode: str = "complete") -> Run:
    """Runs over all that is there. Each micro-batch writes a folder of its own in the shared folder, so one that is run again writes it again:
    all of them together are what was appended; the last one is the complete table.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.path}/result/{'last' if mode == 'complete' else f'batch={n}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{scratch.path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"] for p in query.recentProgress]
    schema = stream.schema if mode == "complete" else StructType([*stream.schema.fields]).add("batch", "integer")
    at = f"{scratch.path}/result/last" if mode == "complete" else f"{scratch.path}/result"
    if not scratch.fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at)):  # there was no batch
        return Run(spark.createDataFrame([], stream.schema), [], 0)
    table = spark.read.schema(schema).parquet(at)
    return Run(table if mode == "complete" else table.drop("batch"), [sum(s["numRowsTotal"] for s in p) for p in states], sum(s["numRowsDroppedByWatermark"] for p in states for s in p))


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result table after all that is there."""
    return run(stream, mode).table
