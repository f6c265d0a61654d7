"""Vectors laid out in the plane: neighbours attract, sampled others repel, in rounds over tables.

Each round joins the neighbour edges with both ends' places and sums the pulls for each row; the others that push a row away are those some
steps further in an order by number, the steps drawn anew in each round, so everyone meets a few of all the rest by a join of equal numbers.
No task holds more than rows of its own, and what moves is three numbers a row. Curves and clipping are those of low-dimensional neighbour embeddings: nearness is 1 / (1 + a d^2b).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.hashing import u01
from quernstone.operators.ranking import globally_numbered
from quernstone.sources.storage import Scratch

#: Of the curve of nearness for a least distance of 0.1, the largest step, and rounds by default.
A, B, MOST_STEP, ROUNDS, OTHERS = 1.577, 0.895, 4.0, 30, 5


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-MOST_STEP)), F.lit(MOST_STEP))


def plane(near: DataFrame, ids: DataFrame, rounds: int = ROUNDS, others: int = OTHERS, rate: float = 1.0, spread: float = 10.0, seed: int = 42) -> DataFrame:
    """(id, x, y) for ids (id), from neighbours (q, i). Rows without neighbours are pushed only."""
    spark = ids.sparkSession
    scratch, rng = Scratch(spark, "plane"), random.Random(seed)
    edges = near.select(F.col("q").alias("a"), F.col("i").alias("b"))
    edges = scratch.store(edges.union(edges.select("b", "a")).distinct().where("a <> b"))
    place = lambda k: (u01(seed + k, F.col("id")) - 0.5) * spread
    at = scratch.store(globally_numbered(ids.select("id").distinct(), F.col("id"), name="k").select("id", "k", place(1).alias("x"), place(2).alias("y")))
    n = at.count()
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d2 = dx * dx + dy * dy
    pull = F.when(d2 > 0, -2 * A * B * F.pow(d2, B - 1) / (1 + A * F.pow(d2, B))).otherwise(0.0)
    push = 2 * B / ((0.001 + d2) * (1 + A * F.pow(d2, B)))

    def moved(pairs: DataFrame, force: Column) -> DataFrame:
        return pairs.groupBy("id").agg(F.sum(clipped(force * dx)).alias("fx"), F.sum(clipped(force * dy)).alias("fy"))

    for r in range(rounds):
        there = at.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        forces = moved(edges.withColumnRenamed("a", "id").join(at.select("id", "x", "y"), "id").join(there, "b"), pull)
        if n > 1:
            steps = F.array(*(F.lit(rng.randrange(1, n)) for _ in range(others)))
            mates = at.select("id", "x", "y", F.explode(F.transform(steps, lambda s: (F.col("k") + s) % n)).alias("m"))
            forces = forces.union(moved(mates.join(at.select(F.col("k").alias("m"), F.col("x").alias("x2"), F.col("y").alias("y2")), "m"), push))
        sums = forces.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        step = rate * (1 - r / rounds)
        next_ = lambda c, f: (F.col(c) + step * clipped(F.coalesce(f, F.lit(0.0)))).alias(c)  # noqa: B023, E731
        at = scratch.store(at.join(sums, "id", "left").select("id", "k", next_("x", "fx"), next_("y", "fy")))
        if r % 5 == 4:
            edges = scratch.store(edges)  # so that all tables before the last two can go
            at = scratch.store(at)
            scratch.keep_last(2)
    return at.select("id", "x", "y")
