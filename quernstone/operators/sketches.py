"""Sketches that are stored with the parts of a table and merged later, without the rows.

A part's sketches are three binary columns: different values (HLL), quantiles (KLL) and the commonest items. Merging parts gives what
a sketch of all their rows would give, within the same bounds, so a part is read once, and any set of parts is answered from kilobytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the HLL's registers, size of the KLL's levels, items that are tracked.
REGISTERS, LEVEL, TRACKED = 12, 200, 1000
#: Three standard errors of the number of different values, as a share of it; and the error of a rank, as a share of the rows, at 99 percent.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0165


def sketched(df: DataFrame, parts: list[str], distinct: Column, value: Column, item: Column) -> DataFrame:
    """(parts, n, distinct, value, item): a row of sketches for each part. Nulls are left out of a sketch."""
    rows = df.select(*parts, distinct.alias("d_"), value.cast("double").alias("v_"), item.alias("i_"))
    top = F.expr(f"approx_top_k_accumulate(i_, {TRACKED})")
    return rows.groupBy(*parts).agg(F.count("*").alias("n"), F.hll_sketch_agg("d_", REGISTERS).alias("distinct"), F.kll_sketch_agg_double("v_", LEVEL).alias("value"), top.alias("item"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of parts as those of the groups by keys."""
    top = F.expr(f"approx_top_k_combine(item, {TRACKED})")
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("value").alias("value"), top.alias("item"))


def answers(sketches: DataFrame, keys: list[str], quantiles: list[float], top: int) -> DataFrame:
    """(keys, n, distinct, distinct_low, distinct_high, quantiles, top): estimates with bounds. top: array of (item, count), largest first; ties by item."""
    about = F.hll_sketch_estimate("distinct").cast("double")
    # A bound at three standard errors; below some hundred values the sketch holds them all.
    low, high = F.floor(about / (1 + DISTINCT_ERROR)), F.ceil(about / (1 - DISTINCT_ERROR))
    values = F.kll_sketch_get_quantile_double("value", F.array(*map(F.lit, quantiles)))
    found = F.expr(f"approx_top_k_estimate(item, {TRACKED})")
    ordered = F.slice(F.array_sort(found, lambda x, y: F.when(x["count"] != y["count"], F.when(x["count"] > y["count"], -1).otherwise(1)).when(x["item"] == y["item"], 0).when(x["item"] < y["item"], -1).otherwise(1)), 1, top)
    return sketches.select(*keys, "n", about.cast("long").alias("distinct"), low.cast("long").alias("distinct_low"), high.cast("long").alias("distinct_high"), values.alias("quantiles"), ordered.alias("top"))
