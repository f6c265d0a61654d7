"""Cleaning of raw sources by recipes: nested columns become columns, lists become flags, dead and leaking columns go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import parse_flex
from quernstone.sources.datasets import exists, listed
from quernstone.sources.tables import read_any, union_provenance


@dataclass(frozen=True)
class Recipe:
    """drop: columns that go first; flatten: columns with objects; flags: list or object column -> prefix; dead: ids that go with constant columns; parts: files by stem that are put one after the other."""

    drop: tuple[str, ...] = ()
    flatten: tuple[str, ...] = ()
    flags: tuple[tuple[str, str], ...] = ()
    dead: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    provenance: bool = False


#: Most options of a list column that become flags.
MOST_FLAGS = 150
CARS = ("model_info", "super_gen", "complectation_dict")
# The columns that the six sources have
RECIPES = {
    "lamoda": Recipe(flatten=("about",), drop=("Alsobuy", "Similar"), dead=("id", "Id", "ID")),
    "cars_ru": Recipe(parts=("train", "test"), flags=(("options", "opt"),), dead=("id", "custom")),
    "ozon": Recipe(provenance=True),
    "auto_ru": Recipe(flatten=CARS, flags=(("equipment_dict", "equip"),)),
    "auto_ru_2020": Recipe(flatten=(*CARS, "Владение"), flags=(("equipment_dict", "equip"),)),
    "devices": Recipe(dead=("id",)),
}


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def real_name(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def flatten_column(df: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """A column of JSON or literal objects becomes a column name.key for each of its keys; inner objects name.key.inner.

    A table can't have any number of columns: with more than `most` keys, the first by name get columns and name.rest has the whole objects, as JSON.
    """
    parsed = df.withColumn("parsed_", parse_flex(quoted(name).cast("string")))
    m = F.from_json("parsed_", "map<string,string>")
    inner = F.from_json(F.col("v"), "map<string,string>")
    keys = parsed.select(F.explode(m).alias("k", "v")).select("k", F.when(F.col("v").startswith("{"), F.map_keys(inner)).alias("inner"))
    found = keys.select("k", F.explode_outer("inner").alias("i")).distinct().orderBy("k", "i").limit(most + 1).collect()  # names of columns
    rest, found = len(found) > most, found[:most]
    path = lambda r: "$" + "".join(f"['{x}']" for x in (r["k"], r["i"]) if x is not None)
    columns = {".".join(x for x in (name, r["k"], r["i"]) if x is not None): F.get_json_object("parsed_", path(r)) for r in found}
    return parsed.withColumns(columns | ({f"{name}.rest": F.col("parsed_")} if rest else {})).drop("parsed_", name)


def flag_column(df: DataFrame, name: str, prefix: str, most: int = MOST_FLAGS) -> DataFrame:
    """A column of JSON or literal lists, or of objects by their keys, becomes a flag prefix_option for each of its commonest options; if there are more, prefix.rest lists each row's others."""
    parsed = parse_flex(quoted(name).cast("string"))
    options = F.when(parsed.startswith("["), F.from_json(parsed, "array<string>")).otherwise(F.json_object_keys(parsed))
    listed_ = df.withColumn("options_", F.coalesce(options, F.array().cast("array<string>")))
    common = listed_.select(F.explode(F.array_distinct("options_")).alias("o")).where("o is not null").groupBy("o").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o").limit(most + 1).collect()  # names of columns
    rest, common = len(common) > most, [r["o"] for r in common[:most]]
    others = {f"{prefix}.rest": F.array_except("options_", F.array(*map(F.lit, common)))} if rest else {}
    return listed_.withColumns({f"{prefix}_{o}": F.array_contains("options_", o) for o in common} | others).drop("options_", name)


def drop_dead(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that have one value at most, and without `more`. Nested columns stay."""
    plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    ends = df.agg(*(F.struct(F.min(quoted(c).cast("string")).alias("a"), F.max(quoted(c).cast("string")).alias("b")).alias(f"c{i}") for i, c in enumerate(plain))).first()
    dead = {c for i, c in enumerate(plain) if ends[f"c{i}"]["a"] == ends[f"c{i}"]["b"]} | set(more)
    return df.select(*(quoted(c) for c in df.columns if c not in dead))


def drop_leaking(df: DataFrame, *keys: str) -> DataFrame:
    """Without the keys that labels were made from, which would give them away."""
    return df.select(*(quoted(c) for c in df.columns if c not in keys))


def prepare(df: DataFrame, recipe: Recipe) -> DataFrame:
    for name in recipe.flatten:
        if found := real_name(df, name):
            df = flatten_column(df, found)
    for name, prefix in recipe.flags:
        if found := real_name(df, name):
            df = flag_column(df, found, prefix)
    return drop_dead(df.select(*(quoted(c) for c in df.columns if c not in recipe.drop)), recipe.dead)


def prepare_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source that lies in a folder, by its recipe: the parts that the recipe names, all files with their names, or the first file."""
    recipe = RECIPES[name]
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    files = [f for f in listed(spark, folder) if f.rsplit(".", 1)[-1].lower() in ("csv", "parquet", "json", "jsonl")]
    chosen = [f for p in recipe.parts for f in files if f.rsplit(".", 1)[0] == p] or (files if recipe.provenance else files[:1])
    read = {f: read_any(spark, f"{folder}/{f}") for f in chosen}
    df = union_provenance(read, "__source_file") if recipe.provenance else union_provenance(read, "part_").drop("part_")
    nested = [c for c, kind in df.dtypes if kind.startswith("struct")]
    while nested:  # JSON files come with structs
        df = df.select(*(quoted(c) for c in df.columns if c not in nested), *(quoted(c)[k].alias(f"{c}.{k}") for c in nested for k in df.schema[c].dataType.names))
        nested = [c for c, kind in df.dtypes if kind.startswith("struct")]
    return prepare(df, recipe)
