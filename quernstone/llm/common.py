"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.storage import checkpointed  # noqa: F401  used by the operators

#: Separators of words: ASCII white space. Also what Python's bytes.split() splits on.
BLANKS = r"[\x20\x09-\x0D]+"

def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of df (case is ignored)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """The column of this very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions; work is cut in proportion to it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.array_remove(F.split(text, BLANKS), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
