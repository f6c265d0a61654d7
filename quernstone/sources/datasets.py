"""Data sets as they lie in folders: fetching, finding tables by name, labels, prepared pairs with their vectors."""

from __future__ import annotations

import logging
import os
import tarfile
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import tables as S
from quernstone.sources.registry import Registry, public_sources

log = logging.getLogger(__name__)
#: Files of a folder that are no tables of it.
NO_TABLES = ("labeled_data", "candset")
SPLITS = ("train", "valid", "test")


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reads, in order; empty if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fetch(name: str, folder: str, registry: Registry | None = None, retrieve: Callable[[str, str], object] = urllib.request.urlretrieve) -> str:
    """The folder of a source's tables; its archive is fetched and unpacked unless they are there. A file operation of the driver."""
    source = (registry or public_sources()).get(name)
    tables, archive = os.path.join(folder, name, "csv_files"), os.path.join(folder, f"{name}.tar.gz")
    if os.path.isdir(tables) and os.listdir(tables):
        return tables
    os.makedirs(folder, exist_ok=True)
    if not os.path.exists(archive):
        retrieve(source.url, archive)
    with tarfile.open(archive, "r:gz") as packed:
        packed.extractall(folder, filter="data")
    os.unlink(archive)
    return tables


def tables_of(spark: SparkSession, folder: str, name: str | None = None, registry: Registry | None = None) -> dict[str, DataFrame]:
    """tableA and tableB where the source's name, or that of the folder, is known; else every CSV file by its name."""
    registry = registry or public_sources()
    parts = folder.rstrip("/").split("/")
    own = name or (parts[-2] if parts[-1] == "csv_files" and len(parts) > 1 else parts[-1])
    files = [f for f in listed(spark, folder) if f.endswith(".csv")]
    known = registry.sources.get(own)
    wanted = {"tableA": known.table_a, "tableB": known.table_b} if known else {}
    found = {key: f"{table}.csv" for key, table in wanted.items() if f"{table}.csv" in files}
    if len(found) < 2:
        for f in files:
            if f[:-4] not in NO_TABLES:
                found.setdefault(f[:-4], f)
    out = {key: S.read_csv(spark, f"{folder}/{f}") for key, f in found.items()}
    return {key: S.normalize_id(df) if key in ("tableA", "tableB") else df for key, df in out.items()}


def load(spark: SparkSession, folder: str, name: str | None = None, split: bool = True, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42, registry: Registry | None = None) -> dict[str, DataFrame]:
    """The tables of a folder, labeled_data where it is, and its exact-size splits train, valid and test (ltable_id, rtable_id, label)."""
    out = tables_of(spark, folder, name, registry)
    if exists(spark, f"{folder}/labeled_data.csv"):
        out["labeled_data"] = labeled = S.read_csv(spark, f"{folder}/labeled_data.csv")
        ends = [c.lower() for c in labeled.columns]
        if split and any(c.startswith("ltable.") for c in ends) and any(c.startswith("rtable.") for c in ends):
            pairs = S.normalize_labels(labeled)
            cut = S.split_exact(pairs, ratios[1:], seed, F.col("ltable_id"), F.col("rtable_id"), F.col("label"))
            out |= {s: cut.where(F.col("split") == s).drop("split") for s in SPLITS}
        elif split:
            log.warning("no columns ltable.* and rtable.* among %s", labeled.columns)
    return out


def load_local(spark: SparkSession, table_a: str, table_b: str, labels: str) -> dict[str, DataFrame]:
    """Three CSV files of any names."""
    return {key: spark.read.csv(path, header=True, inferSchema=True) for key, path in (("tableA", table_a), ("tableB", table_b), ("labels", labels))}


def load_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None with a warning if it is not there."""
    if not exists(spark, path):
        log.warning("there is no %s", path)
        return None
    return spark.read.parquet(path)


def load_prepared(spark: SparkSession, name: str, tables: str, vectors: str) -> dict[str, object] | None:
    """Tables, splits and vectors of a prepared pair; None with a warning if a required one is missing.

    Below tables/name: tableA and tableB, train and perhaps valid and test, CSV. Below vectors/name: column_embeddings_a and _b (col,
    v), row_embeddings_a and _b (id, v), Parquet.
    """
    at = {f"table_{s.lower()}": f"{tables}/{name}/table{s}.csv" for s in "AB"}
    emb = {f"{kind}_{s}": f"{vectors}/{name}/{kind}_{s}" for kind in ("column_embeddings", "row_embeddings") for s in "ab"}
    train = f"{tables}/{name}/train.csv"
    lacking = [p for p in (*at.values(), train, *emb.values()) if not exists(spark, p)]
    if lacking:
        log.warning("%s is left out, there is no %s", name, ", ".join(lacking))
        return None
    splits = {s: S.read_csv(spark, p) for s in SPLITS if exists(spark, p := f"{tables}/{name}/{s}.csv")}
    return {key: S.read_csv(spark, p) for key, p in at.items()} | {"splits": splits} | {key: spark.read.parquet(p) for key, p in emb.items()}
