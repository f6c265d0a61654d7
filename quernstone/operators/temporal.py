"""Joins on time and order: the last row before, and rows inside an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators.ranking import range_number, ranged
from quernstone.sources.storage import stored


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], tie: str) -> DataFrame:
    """left with the values of the last row of right at or before each of its rows, by key; null if there is none.

    Both sides are put in ranges by (key, at, side), which cut a key of any size, and no pair is made. Inside a range the last row of right
    goes down; a range's rows before the first of these get what the nearest range before has of the key, from a row for each key and range.
    Of rows of right at the same time the last by `tie`, a column of right, counts. Rows with a null key or time find nothing.
    """
    own = [c for c in left.columns if c not in (key, at)]
    types = dict(right.dtypes)
    hit = F.struct(F.lit(True).alias("there"), *(F.col(v).alias(v) for v in values))
    a = left.select(F.col(key), F.col(at), F.lit(1).alias("side"), F.lit(None).cast(types[tie]).alias("tie"), F.struct(F.lit(1).alias("one"), *own).alias("own"))
    b = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), F.lit(0).alias("side"), F.col(tie).alias("tie"), hit.alias("hit"))
    order = [F.col(at), F.col("side"), F.col("tie")]
    rows = ranged(a.unionByName(b, allowMissingColumns=True), F.col(key), *order).withColumn("range", range_number())
    inside = W.partitionBy("range", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("here", F.last("hit", ignorenulls=True).over(inside))
    last = rows.where("side = 0").groupBy("range", key).agg(F.max_by("hit", F.struct(at, "tie")).alias("hit"))
    # For the ranges that hold the key: the last row of right in those before.
    spans = rows.groupBy("range", key).agg(F.count("*").alias("n")).join(last, ["range", key], "left")
    earlier = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(F.col("range").alias("range of"), F.col(key).alias("key of"), F.last("hit", ignorenulls=True).over(earlier).alias("carried"))
    on = (F.col("range") == F.col("range of")) & F.col(key).eqNullSafe(F.col("key of"))
    found = found.where("side = 1").join(carried, on).withColumn("found", F.coalesce("here", "carried"))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    return found.select(key, at, *(F.col(f"own.{c}").alias(c) for c in own), *(F.when(known, F.col(f"found.{v}")).alias(v) for v in values))


#: Levels of aligned pieces: 1, 2, 4, ... seconds up to 2 ** 40, which is longer than time.
LEVELS = 41


def pieces(start: Column, end: Column) -> Column:
    """The aligned pieces of growing and then shrinking width that [start, end) is made of, at most two of each width: array of (level, index)."""
    every = []
    for n in range(LEVELS):
        low, high = -F.shiftright(-start, n), F.shiftright(end, n)
        piece = lambda i: F.struct(F.lit(n).alias("level"), i.alias("index"))  # noqa: B023, E731
        some = low < high
        every += [F.when(some & (low.bitwiseAND(1) == 1), piece(low)), F.when(some & (high.bitwiseAND(1) == 1), piece(high - 1))]
    return F.array_compact(F.array(*every))


#: Spans that a key may have for its points to meet them all.
FEW_SPANS = 64


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, few: int = FEW_SPANS) -> DataFrame:
    """Points with the spans that hold them: same key, start <= at < end. Times as whole seconds since 1970, in long columns.

    A point meets all spans of its key if these are `few` at most. A span of a key with more is listed under the dyadic pieces that it is made
    of, two for each level at most, whatever its length; a point looks up one piece of each level that is in use. The pieces of a span don't
    overlap, so each pair comes once, and every row that meets is a result. Only merge joins: what a span is listed under is never broadcast.
    """
    spans = spans.where(F.col(end) > F.col(start))
    many = stored(spans.groupBy(key).agg(F.count("*").alias("spans of")).where(F.col("spans of") > few).select(key))
    holds = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    if many.isEmpty():
        return points.join(spans.hint("merge"), key).where(holds)
    many = many.hint("merge")
    cold = points.join(spans.join(many, key, "left_anti").hint("merge"), key).where(holds)
    s = spans.join(many, key, "left_semi").withColumn("piece of", F.explode(pieces(F.col(start).cast("long"), F.col(end).cast("long"))))
    used = sorted(r[0] for r in s.select("piece of.level").distinct().collect())  # LEVELS rows at most
    probes = F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(F.col(at).cast("long"), n).alias("index")) for n in used))
    probing = points.where(F.col(at).isNotNull()).join(many, key, "left_semi").withColumn("piece of", F.explode(probes))
    return cold.unionByName(probing.join(s.hint("merge"), [key, "piece of"]).drop("piece of"))
