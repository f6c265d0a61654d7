"""Message passing, attention weights, losses and negative mining on tables of vectors, for fixed weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.vectors import distance


def mean_message(edges: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """(dst, message): the mean of the sources' vectors; the mean commutes with a linear layer, so the layer comes after.

    An average for each dimension, so partial sums are exchanged and not a row for each edge and dimension.
    """
    v = edges.join(nodes.select(F.col("id").alias("src"), "v"), "src")
    return v.groupBy("dst").agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(dims))).alias("message"))


def edge_softmax(edges: DataFrame, score: Column, dst: str = "dst") -> DataFrame:
    """edges with weight: softmax of the score over the edges of a target, shifted by its largest score.

    Maxima and sums come from grouped aggregation and are joined, so the edges of a hub need not meet in one task.
    """
    e = edges.withColumn("score_", score)
    most = e.groupBy(dst).agg(F.max("score_").alias("most_"))
    e = e.join(most, dst).withColumn("exp_", F.exp(F.col("score_") - F.col("most_")))
    sums = e.groupBy(dst).agg(F.sum("exp_").alias("sum_"))
    return e.join(sums, dst).withColumn("weight", F.col("exp_") / F.col("sum_")).drop("score_", "most_", "exp_", "sum_")


def triplet_distances(triplets: DataFrame, vectors: DataFrame, eps: float = 1e-6) -> DataFrame:
    """triplets (a, p, n) with their vectors' distances d_ap and d_an."""
    out = triplets
    for c in ("a", "p", "n"):
        out = out.join(vectors.select(F.col("id").alias(c), F.col("v").alias(f"v{c}")), c)
    return out.select("a", "p", "n", distance(F.col("va"), F.col("vp"), eps).alias("d_ap"), distance(F.col("va"), F.col("vn"), eps).alias("d_an"))


def triplet_loss(triplets: DataFrame, vectors: DataFrame, margin: float = 0.3) -> DataFrame:
    d = triplet_distances(triplets, vectors)
    return d.agg(F.coalesce(F.avg(F.greatest(F.col("d_ap") - F.col("d_an") + margin, F.lit(0.0))), F.lit(0.0)).alias("loss"), F.count("*").alias("n"))


def semi_hard(d: DataFrame, margin: float) -> DataFrame:
    """Of (…, d_ap, d_an), squared: negatives within the margin; with fewer than max(1, n / 4) of them the hard ones too; else all."""
    hard = F.col("d_an") <= F.col("d_ap")
    semi = (F.col("d_an") > F.col("d_ap")) & (F.col("d_an") < F.col("d_ap") + margin)
    n = d.agg(F.count("*").alias("n_"), F.count_if(semi).alias("semi_"), F.count_if(hard).alias("hard_"))
    enough = F.col("semi_") >= F.greatest(F.lit(1), F.floor(F.col("n_") / 4))
    keep = F.when(enough, semi).when(F.col("semi_") + F.col("hard_") > 0, semi | hard).otherwise(F.lit(True))
    return d.crossJoin(F.broadcast(n)).where(keep).drop("n_", "semi_", "hard_")  # one row


def learning_rate(step: Column, base: float, warm_up: Column, total: Column) -> Column:
    """Linear warm-up, then a cosine to zero."""
    done = (step - warm_up) / F.greatest(F.lit(1), total - warm_up).cast("double")
    return F.when(step < warm_up, base * step / F.greatest(F.lit(1), warm_up).cast("double")).otherwise(base * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(done, F.lit(1.0)))))
