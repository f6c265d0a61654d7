"""Row matchers on the row-token graph: aggregation layers as DataFrame operations, a projection trained by distributed gradients.

The graph is (dst row, src token, col). A layer mixes each row with its tokens: by their mean (mean layer) or by attention over
them with the column's vector as edge feature. Weights are small matrices on the driver; vectors stay in Spark. Training learns
the projection after the layers: with fixed layers every row's features are computed once and stored, and an epoch is one pass
in which each partition sums the gradient of its triplets or pairs, so the driver sees two matrices for each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.vectors import l2_normalize
from quernstone.operators.losses import edge_softmax
from quernstone.sources.storage import stored


@dataclass(frozen=True)
class ModelServerConfig:
    host: str = "http://localhost:11434"
    model: str = ""
    embedding_model: str = ""


@dataclass(frozen=True)
class SchemaConfig:
    embedding_dim: int = 4096
    hidden_dim: int = 1024
    projection_dim: int = 256
    margin: float = 0.3
    rate: float = 1e-3
    epochs: int = 50
    batch_size: int = 64


@dataclass(frozen=True)
class RowModelConfig:
    """layers of kind "mean" or "attention"; patience: epochs without a better validation loss before the rate is halved, twice that before the end."""

    kind: str = "mean"
    layers: int = 2
    heads: int = 4
    hidden_dim: int = 32
    output_dim: int = 32
    margin: float = 0.3
    rate: float = 0.05
    weight_decay: float = 5e-4
    epochs: int = 50
    patience: int = 5
    temperature: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Config:
    server: ModelServerConfig = field(default_factory=ModelServerConfig)
    schema: SchemaConfig = field(default_factory=SchemaConfig)
    rows: RowModelConfig = field(default_factory=RowModelConfig)


def load_config(text: str, base: RowModelConfig = RowModelConfig()) -> RowModelConfig:
    """base with the values of a JSON object; names that it does not have are an error."""
    import json

    return replace(base, **json.loads(text))


def mapped(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray], id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(id, v): f of the vectors, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": list(f(np.vstack(b["v"].to_list())))})

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInPandas(run, f"id {kind}, v array<double>")


def linear(vectors: DataFrame, weight: np.ndarray) -> DataFrame:
    return mapped(vectors, lambda x: x @ weight)


def vector_sum(v: Column, dims: int, weight: Column | None = None) -> Column:
    """Sum of vectors in a group: a sum for each dimension, so partial sums and not vectors are exchanged."""
    part = lambda i: F.get(v, F.lit(i)) * weight if weight is not None else F.get(v, F.lit(i))
    return F.array(*(F.sum(part(i)) for i in range(dims)))


def mean_layer(edges: DataFrame, rows: DataFrame, tokens: DataFrame, dims: int) -> DataFrame:
    """(id, v): each row plus the mean of its tokens, scaled to length one; rows without tokens stay."""
    e = edges.select("dst", "src").join(tokens.select(F.col("id").alias("src"), "v"), "src")
    sums = e.groupBy("dst").agg(vector_sum(F.col("v"), dims).alias("s"), F.count("*").alias("n"))
    joined = rows.join(sums, F.col("id") == F.col("dst"), "left")
    moved = F.when(F.col("n").isNull(), F.col("v")).otherwise(F.zip_with("v", "s", lambda x, y: x + y / F.col("n")))
    return joined.select("id", l2_normalize(moved).alias("v"))


@dataclass(frozen=True)
class AttentionWeights:
    """Of one head: matrices for sources, targets and edges, and the vector that scores their sum."""

    source: np.ndarray
    target: np.ndarray
    edge: np.ndarray
    score: np.ndarray
    slope: float = 0.2

    @staticmethod
    def drawn(dims_in: int, dims_edge: int, dims: int, rng: np.random.Generator) -> AttentionWeights:
        draw = lambda n: rng.normal(size=(n, dims)) / np.sqrt(n)
        return AttentionWeights(draw(dims_in), draw(dims_in), draw(dims_edge), rng.normal(size=dims) / np.sqrt(dims))


def attention_layer(edges: DataFrame, rows: DataFrame, tokens: DataFrame, columns: DataFrame, heads: list[AttentionWeights]) -> DataFrame:
    """(id, v): the heads' weighted sums of sources, side by side, added to the row where the widths agree.

    Of an edge: score = a . leaky_relu(W_s source + W_t target + W_e column); its weight is the softmax over the edges of the target.
    edges (dst, src, col); rows, tokens and columns (id, v).
    """
    e = edges.select("dst", "src", "col")
    parts = None
    for h in heads:
        dims = len(h.score)
        s, t, c = (linear(d, w).select(F.col("id").alias(k), F.col("v").alias(f"v_{k}")) for d, w, k in ((tokens, h.source, "src"), (rows, h.target, "dst"), (columns, h.edge, "col")))
        met = e.join(s, "src").join(t, "dst").join(c, "col")
        total = F.zip_with(F.zip_with("v_src", "v_dst", lambda x, y: x + y), "v_col", lambda x, y: x + y)
        active = F.transform(total, lambda x: F.when(x >= 0, x).otherwise(x * h.slope))
        score = F.aggregate(F.zip_with(active, F.array(*map(F.lit, h.score.tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        weighed = edge_softmax(met.select("dst", "v_src", score.alias("score")), F.col("score"))
        mine = weighed.groupBy("dst").agg(vector_sum(F.col("v_src"), dims, F.col("weight")).alias("m"))
        parts = mine if parts is None else parts.join(mine.withColumnRenamed("m", "more"), "dst").select("dst", F.concat("m", "more").alias("m"))
    joined = rows.join(parts, F.col("id") == F.col("dst"), "left")
    same = F.size("v") == F.size("m")
    moved = F.when(F.col("m").isNull(), F.col("v")).when(same, F.zip_with("v", "m", lambda x, y: x + y)).otherwise(F.col("m"))
    return joined.select("id", l2_normalize(moved).alias("v"))


def features(edges: DataFrame, rows: DataFrame, tokens: DataFrame, columns: DataFrame, config: RowModelConfig) -> DataFrame:
    """(id, v): the rows after all layers, stored. Vectors of rows and tokens are of one width."""
    dims = len(rows.select("v").first()[0])
    rng = np.random.default_rng(config.seed)
    for _ in range(config.layers):
        if config.kind == "mean":
            rows = mean_layer(edges, rows, tokens, dims)
        else:
            wide = len(columns.select("v").first()[0])
            rows = attention_layer(edges, rows, tokens, columns, [AttentionWeights.drawn(dims, wide, dims // config.heads, rng) for _ in range(config.heads)])
        rows = stored(rows)
    return rows


def project(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    y = x @ weight
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def back(x: np.ndarray, weight: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The gradient of the weight, from that of the projected, normalised vectors."""
    z = x @ weight
    norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = z / norm
    return x.T @ ((grad - y * (grad * y).sum(1, keepdims=True)) / norm)


def triplet_gradient(x: list[np.ndarray], weight: np.ndarray, config: RowModelConfig) -> tuple[float, np.ndarray]:
    """Summed loss and gradient of triplets: max(0, |a - p| - |a - n| + margin)."""
    a, p, n = (project(v, weight) for v in x)
    ap, an = a - p, a - n
    d_ap, d_an = (np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9) for d in (ap, an))
    loss = np.maximum(d_ap - d_an + config.margin, 0)
    on = (loss > 0).astype(float)
    grads = (on * (ap / d_ap - an / d_an), on * -ap / d_ap, on * an / d_an)
    return float(loss.sum()), sum(back(v, weight, g) for v, g in zip(x, grads, strict=True))


def pair_gradient(x: list[np.ndarray], weight: np.ndarray, config: RowModelConfig, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and gradient of labelled pairs: cross entropy of the logistic of similarity over temperature."""
    a, b = (project(v, weight) for v in x)
    z = (a * b).sum(1) / config.temperature - 0.5 / config.temperature
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = -(labels * np.log(np.maximum(p, 1e-12)) + (1 - labels) * np.log(np.maximum(1 - p, 1e-12)))
    g = ((p - labels) / config.temperature)[:, None]
    return float(loss.sum()), back(x[0], weight, g * b) + back(x[1], weight, g * a)


class RowMatcher:
    """A projection of row features to unit vectors of rows that match. fit() keeps the weights of the best validation loss."""

    def __init__(self, dims_in: int, config: RowModelConfig = RowModelConfig()):
        self.config = config
        self.weight = np.random.default_rng(config.seed).normal(size=(dims_in, config.output_dim)) / np.sqrt(dims_in)
        self.history: list[dict[str, float]] = []

    def embeddings(self, rows: DataFrame) -> DataFrame:
        """(id, v): the rows' unit vectors."""
        weight = self.weight
        return mapped(rows, lambda x: project(x, weight))

    def gathered(self, examples: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """examples with the features of each of their rows, stored once for all epochs."""
        out = examples
        for c in names:
            out = out.join(rows.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")), c)
        label = F.col("label").cast("double") if "label" in examples.columns else F.lit(1.0)
        return stored(out.select(*(f"v_{c}" for c in names), label.alias("label")))

    def passed(self, examples: DataFrame, names: tuple[str, ...]) -> tuple[float, np.ndarray]:
        """Mean loss and gradient over all examples; a partition sends one sum."""
        weight, config = self.weight, self.config

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, grad, n = 0.0, np.zeros_like(weight), 0
            for b in batches:
                if len(b):
                    x = [np.vstack(b[f"v_{c}"].to_list()) for c in names]
                    more, g = triplet_gradient(x, weight, config) if len(names) == 3 else pair_gradient(x, weight, config, b["label"].to_numpy())
                    loss, grad, n = loss + more, grad + g, n + len(b)
            yield pd.DataFrame({"loss": [loss], "n": [n], "grad": [grad.ravel()]})

        sums = examples.mapInPandas(run, "loss double, n long, grad array<double>")
        size = weight.size
        total = sums.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"), *([vector_sum(F.col("grad"), size).alias("grad")] if size <= 4096 else [])).first()
        n = max(total["n"] or 0, 1)
        grad = np.array(total["grad"]) if size <= 4096 else np.sum([r["grad"] for r in sums.select("grad").toLocalIterator()], axis=0)
        return (total["loss"] or 0.0) / n, grad.reshape(weight.shape) / n

    def fit(self, sets: list[tuple[DataFrame, DataFrame]], validation: list[tuple[DataFrame, DataFrame]] | None = None, on_epoch: Callable[[int, dict[str, float]], bool | None] | None = None) -> list[dict[str, float]]:
        """sets: (examples, features of rows) of each data set, one after the other in each epoch. Examples are triplets (a, p, n) or pairs (a, b, label).

        on_epoch gets the number and losses of each epoch; True from it ends the training. Without validation the training loss decides.
        """
        names = [("a", "p", "n") if "p" in examples.columns else ("a", "b") for examples, _ in sets]
        train = [(self.gathered(e, r, n), n) for (e, r), n in zip(sets, names, strict=True)]
        if not any(e.limit(1).count() for e, _ in train):
            raise ValueError("there is nothing to train on")
        held = [(self.gathered(e, r, n), n) for e, r in validation or [] for n in [("a", "p", "n") if "p" in e.columns else ("a", "b")]]
        rate, best, kept, waited = self.config.rate, float("inf"), self.weight, 0
        for epoch in range(self.config.epochs):
            losses = []
            for e, n in train:
                loss, grad = self.passed(e, n)
                losses.append(loss)
                self.weight = self.weight - rate * (grad + self.config.weight_decay * self.weight)
            now = {"train": float(np.mean(losses)), "rate": rate}
            now["valid"] = float(np.mean([self.passed(e, n)[0] for e, n in held])) if held else now["train"]
            self.history.append(now)
            if now["valid"] < best - 1e-6:
                best, kept, waited = now["valid"], self.weight, 0
            else:
                waited += 1
                if waited % self.config.patience == 0:
                    rate /= 2
            if waited >= 2 * self.config.patience or on_epoch and on_epoch(epoch, now):
                break
        self.weight = kept
        return self.history


def search(base: RowModelConfig, grid: dict[str, list], judge: Callable[[RowModelConfig], float], trials: int, seed: int = 42) -> tuple[RowModelConfig, list[tuple[dict, float]]]:
    """The best of `trials` different random choices from a grid, by judge (larger is better), and all of them."""
    rng, seen, tried = np.random.default_rng(seed), set(), []
    most = int(np.prod([len(v) for v in grid.values()]))
    while len(tried) < min(trials, most):
        choice = {k: v[int(rng.integers(len(v)))] for k, v in grid.items()}
        if (key := tuple(choice.items())) not in seen:
            seen.add(key)
            tried.append((choice, judge(replace(base, **choice))))
    return replace(base, **max(tried, key=lambda x: x[1])[0]), tried


def principal_components(vectors: DataFrame, n: int = 2, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(id, pc array<double>): coordinates on the first n principal components of the centred vectors; the largest entry of each axis is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    axes = PCA(k=n, inputCol="x", outputCol="y").fit(v.select(array_to_vector("v").alias("x"))).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(n)])
    dims = len(axes)
    mean = np.array(v.agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(dims)))).first()[0])
    return mapped(v, lambda x: (x - mean) @ axes).withColumnRenamed("v", "pc")
