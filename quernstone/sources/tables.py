"""Reading tables of any format, id conventions, labels, exact-size splits, unions with provenance, sinks and layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.ranking import hash_ranked

ID_NAMES = ("id", "ID", "Id", "_id")


@dataclass(frozen=True)
class ERDataset:
    """Two tables and their labelled pairs, whole and by split."""

    a: DataFrame
    b: DataFrame
    labels: DataFrame | None = None
    splits: dict[str, DataFrame] = field(default_factory=dict)


def parse_csv_lines(lines: DataFrame, columns: list[str], comment: str = "#", line: str = "value") -> DataFrame:
    """Rows of lines of text: comments go first, then lines with more fields than columns; missing fields are null. All strings."""
    ddl = ", ".join(f"`{c}` string" for c in [*columns, "overflow_"])
    parsed = lines.where(~F.col(line).startswith(comment)).select(F.from_csv(line, ddl).alias("r"))
    return parsed.where(F.col("r.overflow_").isNull()).select(*(F.col("r")[c].alias(c) for c in columns))


def read_csv(spark: SparkSession, path: str, comment: str = "#", encoding: str = "ISO-8859-1") -> DataFrame:
    """A CSV file with a header, comment lines before parsing and lines with too many fields left out; types are inferred."""
    head = spark.read.option("encoding", encoding).csv(path, header=True, comment=comment)
    schema = spark.read.csv(path, header=True, inferSchema=True, comment=comment, encoding=encoding).schema
    wide = spark.read.schema(", ".join(f"`{c}` string" for c in [*head.columns, "overflow_"])).csv(path, comment=comment, encoding=encoding, enforceSchema=True, header=True)
    kept = wide.where(F.col("overflow_").isNull())
    return kept.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending: csv, parquet, orc, json lines or a json array."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        lines = spark.read.json(path)
        return spark.read.json(path, multiLine=True) if "_corrupt_record" in lines.columns else lines
    if kind == "csv":
        return read_csv(spark, path)
    return spark.read.format("orc" if kind == "orc" else "parquet").load(path)


def id_column(columns: list[str]) -> str:
    """The first of the usual names, else the first column."""
    return next((c for c in ID_NAMES if c in columns), columns[0])


def normalize_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(id_column(df.columns), "id")


def label_columns(columns: list[str]) -> tuple[str, str, str]:
    """Left id, right id and label by prefix and name; the last column is the label if none is named so."""
    left = next(c for c in columns if c.startswith("ltable"))
    right = next(c for c in columns if c.startswith("rtable"))
    return left, right, next((c for c in columns if c.lower() in ("gold", "label", "match")), columns[-1])


def normalize_labels(df: DataFrame) -> DataFrame:
    """(ltable_id string, rtable_id string, label int)."""
    names = [F.col(f"`{c}`") for c in label_columns(df.columns)]
    return df.select(names[0].cast("string").alias("ltable_id"), names[1].cast("string").alias("rtable_id"), names[2].cast("int").alias("label"))


def split_exact(df: DataFrame, ratios: tuple[float, float], seed: int, *keys: Column) -> DataFrame:
    """df with split: of n rows max(1, int(n * ratio)) are valid and as many test by their ratio, the rest train; rows by hash."""
    ranked = hash_ranked(df, seed, *keys, name="rank_")
    total = df.agg(F.count("*").alias("total_"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    test = F.greatest(F.lit(1), F.floor(F.col("total_") * ratios[1]))
    valid = F.greatest(F.lit(1), F.floor(F.col("total_") * ratios[0]))
    split = F.when(F.col("rank_") < test, "test").when(F.col("rank_") < test + valid, "valid").otherwise("train")
    return ranked.withColumn("split", split).drop("rank_", "total_")


def union_provenance(parts: dict[str, DataFrame], name: str = "source_file") -> DataFrame:
    """All parts by column name, missing columns null, with the part they come from."""
    out = None
    for source, df in parts.items():
        df = df.withColumn(name, F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_dataset(dataset: ERDataset, path: str) -> None:
    """tableA, tableB, and the labelled pairs by split."""
    dataset.a.write.mode("overwrite").parquet(f"{path}/tableA")
    dataset.b.write.mode("overwrite").parquet(f"{path}/tableB")
    if dataset.splits:
        union_provenance(dataset.splits, "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/pairs")


def load_dataset(spark: SparkSession, path: str) -> ERDataset:
    """What write_dataset wrote."""
    pairs = spark.read.parquet(f"{path}/pairs")
    splits = {s: pairs.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")}
    return ERDataset(spark.read.parquet(f"{path}/tableA"), spark.read.parquet(f"{path}/tableB"), pairs, splits)


def json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that know none."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def layout(root: str, kind: str, tag: str, name: str | None = None) -> str:
    """<root>/<kind>/<tag>[/<name>]: columns, rows, graphs, unified and output live in namespaces of their model's tag."""
    if kind not in ("columns", "rows", "graphs", "unified", "output"):
        raise ValueError(f"unknown kind of artefact: {kind}")
    return "/".join([root, kind, tag.replace("/", "_"), *([name] if name else [])])


def shard(rank: Column, total: Column, shards: int) -> Column:
    """Ranges of floor(total / shards) rows; the last takes the rest."""
    size = F.greatest(F.floor(total / shards), F.lit(1))
    return F.least(F.floor(rank / size), F.lit(shards - 1)).cast("int")
