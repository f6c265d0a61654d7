"""Ranks, caps, dedups and running sums. Global ones never sort a table in one task: rows fall into ordered ranges first.

The ranges are Spark's own range partitions by the whole order, tie-breakers included, so equal keys can be cut. They are
stored once, so every later use sees the same cuts. What one task sees whole is a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.hashing import order_key
from quernstone.sources.storage import stored

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def dedup_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df, stored, with "row in range": the number of the row's range above ROW_BITS, its place in the sorted range below."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row in range", F.monotonically_increasing_id()))


def range_number() -> Column:
    return F.shiftright("row in range", ROW_BITS)


def globally_numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Global row number from 0 in the given order: the place in its range plus the rows of the ranges before."""
    rows = ranged(df, *order)
    sizes = rows.groupBy(range_number().alias("range")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("rows before"))  # a row for each range
    place = F.col("row in range").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.join(F.broadcast(sizes), range_number() == F.col("range")).withColumn(name, (place + F.col("rows before")).cast("long")).drop("range", "rows before", "row in range")


def numbered(df: DataFrame, key: str, *more: Column, name: str = "row_idx") -> DataFrame:
    """Global row number from 0 by a column, then by more."""
    return globally_numbered(df, F.col(key), *more, name=name)


def hash_ranked(df: DataFrame, seed: int, *keys: Column, name: str = "hash_rank") -> DataFrame:
    """Global row number from 0 in an order that a seed fixes."""
    return globally_numbered(df.withColumn("hash_", order_key(seed, *keys)), F.col("hash_"), *keys, name=name).drop("hash_")


def hash_sample(df: DataFrame, n: int, seed: int, *keys: Column) -> DataFrame:
    """n rows, by hash."""
    return df.orderBy(order_key(seed, *keys), *keys).limit(n)


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str], many: bool = False) -> DataFrame:
    """df with running sums by key in the given order, the row itself included. sums: name of the sum -> column.

    Sums run inside ranges; what the ranges before hold of the key is added, from a row for each key and range. If these are many, they are merged, never broadcast.
    """
    rows = ranged(df, *(F.col(k) for k in keys), *order).withColumn("range", range_number())
    inside = W.partitionBy("range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("range", *keys).agg(*(F.sum(c).alias(f"{n} total") for n, c in sums.items()))
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("range").alias("range of"), *(F.col(k).alias(f"{k} of") for k in keys), *(F.coalesce(F.sum(f"{n} total").over(earlier), F.lit(0)).alias(f"{n} before") for n in sums))
    summed = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    on = [F.col("range") == F.col("range of"), *(F.col(k).eqNullSafe(F.col(f"{k} of")) for k in keys)]
    joined = summed.join(before.hint("merge") if many else before, on).withColumns({n: F.col(n) + F.col(f"{n} before") for n in sums})
    return joined.drop("range", "range of", "row in range", *(f"{k} of" for k in keys), *(f"{n} before" for n in sums))


def quantiles(df: DataFrame, value: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; nulls are left out. Equal values are one row with their number, which are ranked in ranges;
    two rows of each quantile come to the driver."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    values = stored(running_sums(rows.groupBy("v").agg(F.count("*").alias("n")), [], [F.col("v")], {"upto": "n"}))
    n = values.agg(F.max("upto")).first()[0] or 0
    at = [p * (n - 1) for p in probabilities]
    wanted = sorted({int(x) + d for x in at for d in (0, 1) if int(x) + d < n})
    found = values.select("v", F.explode(F.array(*(F.lit(r).cast("long") for r in wanted or [-1]))).alias("r"), "n", "upto").where("r < upto and r >= upto - n")
    found = {r["r"]: r["v"] for r in found.collect()}
    return [found[int(x)] + (x - int(x)) * (found.get(int(x) + 1, found[int(x)]) - found[int(x)]) if n else None for x in at]
