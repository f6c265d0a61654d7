"""Scores of matchers: thresholds, curves, ranking metrics, clusters. All ties are handled by grouping equal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranking import running_sums


def fbeta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(p + r == 0, F.lit(0.0)).otherwise((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty b."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b, F.lit(0)))


def prf(df: DataFrame, predicted: Column, keys: list[str] | None = None, label: str = "label") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of a boolean prediction, for each key or overall."""
    hit, pos = predicted.cast("int"), F.col(label)
    sums = df.groupBy(*(keys or [])).agg(F.sum(hit * pos).alias("tp"), F.sum(hit * (1 - pos)).alias("fp"), F.sum((1 - hit) * pos).alias("fn"))
    sums = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.withColumn("f1", fbeta(F.col("precision"), F.col("recall"), 1.0))


def curve(df: DataFrame, keys: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """(keys, score, p, n, tp, fp, pos, neg): labels at each different score, and counts with it as threshold.

    The running sums go over different scores, after aggregation, in ranges of (key, score).
    """
    keys = keys or []
    points = df.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    summed = running_sums(points, keys, [F.desc(score)], {"tp": "p", "fp": "n"})
    totals = summed.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return (summed.join(totals, keys) if keys else summed.crossJoin(F.broadcast(totals))).select(*keys, score, "p", "n", "tp", "fp", "pos", "neg")  # one row


def best_threshold(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, f1): the threshold of the highest F1, the lowest of equal ones; 0.5 and 0 if one class is missing."""
    c = curve(df, keys)
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    best = c.withColumn("f1", f1).groupBy(*(keys or [])).agg(F.max_by(F.struct("score", "f1"), F.struct(F.col("f1"), -F.col("score"))).alias("b"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return best.select(*(keys or []), F.when(both, F.col("b.score")).otherwise(0.5).alias("threshold"), F.when(both, F.col("b.f1")).otherwise(0.0).alias("f1"))


def ranking(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, roc_auc, average_precision); null where a class is missing. Ties count half, precision steps by score."""
    keys = keys or []
    c = curve(df, keys)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")) / F.nullif(F.max("pos"), F.lit(0))
    return c.groupBy(*keys).agg(area.alias("roc_auc"), ap.alias("average_precision"))


def same_cluster(pairs: DataFrame, clusters: DataFrame, noise: int = -1) -> DataFrame:
    """pairs (a, b, ...) with predicted: both in one cluster that is not noise. clusters (id, cluster)."""
    ca, cb = (clusters.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}")) for x in ("a", "b"))
    joined = pairs.join(ca, "a").join(cb, "b")
    return joined.withColumn("predicted", (F.col("ca") == F.col("cb")) & (F.col("ca") != noise))


def ari_nmi(df: DataFrame, cluster: str = "cluster", truth: str = "truth") -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labellings, from their contingency table."""
    cells = df.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(cluster).agg(F.sum("n").alias("n")), cells.groupBy(truth).agg(F.sum("n").alias("n"))

    def sums(t: DataFrame, name: str) -> DataFrame:
        pairs, entropy = F.sum(F.col("n") * (F.col("n") - 1) / 2.0), F.sum(F.col("n") * F.log(F.col("n").cast("double")))
        return t.agg(pairs.alias(f"{name}_pairs"), entropy.alias(f"{name}_log"), F.sum("n").alias(f"{name}_n"))

    s = sums(cells, "x").crossJoin(sums(rows, "a")).crossJoin(sums(cols, "b"))  # one row each
    n = F.col("x_n").cast("double")
    expected = F.col("a_pairs") * F.col("b_pairs") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    most = (F.col("a_pairs") + F.col("b_pairs")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("x_pairs") - expected) / F.nullif(most - expected, F.lit(0.0)))
    h_a, h_b = F.log(n) - F.col("a_log") / n, F.log(n) - F.col("b_log") / n
    mutual = F.log(n) + (F.col("x_log") - F.col("a_log") - F.col("b_log")) / n
    nmi = F.when(h_a + h_b == 0, 1.0).otherwise(2 * mutual / F.nullif(h_a + h_b, F.lit(0.0)))
    return s.select(ari.alias("ari"), nmi.alias("nmi"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """(u, z): rank test of group 1 over group 0 with mid-ranks; ranks come from counts of equal values."""
    c = running_sums(df.groupBy(value).agg(F.count("*").alias("n"), F.sum(group).alias("n1")), [], [F.col(value)], {"upto": "n"})
    c = c.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    s = c.agg(F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n0 = F.col("n") - F.col("n1")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    var = F.col("n1") * n0 / 12.0 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1.0)))
    return s.select(u.alias("u"), ((u - F.col("n1") * n0 / 2.0) / F.sqrt(var)).alias("z"))
