"""Sinks of vectors, graphs and traces, and the move of a flat layout into namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.datasets import exists, listed
from quernstone.sources.tables import layout


def write_vectors(vectors: DataFrame, path: str, key: str = "id", vec_col: str = "v") -> None:
    """(key, v array<float>), a column's or a row's vector each."""
    vectors.select(key, F.col(vec_col).cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def write_numpy(vectors: DataFrame, path: str, key: str = "id", vec_col: str = "v", most: int = 100_000) -> None:
    """The vectors in order of their key as one .npy file on the driver; ValueError beyond `most` rows, which write_vectors takes."""
    import numpy as np

    rows = vectors.select(vec_col, key).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} vectors; use write_vectors")
    np.save(path, np.array([r[0] for r in rows], dtype=np.float32))


def write_graph(path: str, rows: DataFrame, tokens: DataFrame, columns: DataFrame, edges: DataFrame) -> dict[str, int]:
    """Four tables (rows, tokens, columns, edges) and one row of counts, which are also returned."""
    parts = {"rows": rows, "tokens": tokens, "columns": columns, "edges": edges}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = rows.sparkSession
    counts = {f"n_{name}": spark.read.parquet(f"{path}/{name}").count() for name in parts}
    spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts)).write.mode("overwrite").json(f"{path}/stats")
    return counts


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("rows", "tokens", "columns", "edges")}


def append_traces(traces: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    traces.write.mode("append").json(path)


def migrate_layout(spark: SparkSession, root: str, tag: str, dry_run: bool = False) -> list[tuple[str, str]]:
    """Moves <root>/<kind>/<name> to <root>/<kind>/<tag>/<name>; what lies there already stays. Gives the moves; doing it again moves nothing."""
    moves = []
    for kind in ("columns", "rows", "graphs", "unified", "output"):
        own = layout(root, kind, tag).rsplit("/", 1)[-1]
        names = listed(spark, f"{root}/{kind}")
        for name in names:
            there = f"{root}/{kind}/{own}/{name}"
            tagged = name == own or any(x.startswith(".tag") for x in listed(spark, f"{root}/{kind}/{name}"))
            if not tagged and not name.startswith(".") and not exists(spark, there):
                moves.append((f"{root}/{kind}/{name}", there))
    path = spark._jvm.org.apache.hadoop.fs.Path
    for source, target in [] if dry_run else moves:
        at = path(target)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at.getParent())
        fs.create(path(f"{target.rsplit('/', 1)[0]}/.tag"), True).close()
        fs.rename(path(source), at)
    return moves
