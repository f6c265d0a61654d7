"""Small models on fixed embeddings: a projection trained on triplets, a pair classifier, graph layers with given weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.vectors import l2_normalize
from quernstone.operators.losses import mean_message


@dataclass(frozen=True)
class TrainingConfig:
    dims: int = 32
    rate: float = 0.05
    epochs: int = 100
    margin: float = 0.3
    seed: int = 42


def pair_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with features: the absolute differences of their vectors (id, v)."""
    for c in ("a", "b"):
        pairs = pairs.join(vectors.select(F.col("id").alias(c), F.col("v").alias(f"v{c}")), c)
    return pairs.withColumn("features", array_to_vector(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)))).drop("va", "vb")


def fit_pair_classifier(pairs: DataFrame, vectors: DataFrame, ridge: float = 0.01) -> LogisticRegressionModel:
    """Logistic regression on |a - b|; the fit is distributed."""
    return LogisticRegression(labelCol="label", regParam=ridge).fit(pair_features(pairs, vectors))


def classify_pairs(model: LogisticRegressionModel, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with score: the probability of a match."""
    return model.transform(pair_features(pairs, vectors)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


class SchemaProjector:
    """A linear projection to unit vectors, trained so that columns that belong together are nearer than others by a margin."""

    def __init__(self, dims_in: int, config: TrainingConfig = TrainingConfig()):
        self.config = config
        self.weight = np.random.default_rng(config.seed).normal(size=(dims_in, config.dims)) / np.sqrt(dims_in)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def loss(self, x: np.ndarray, triplets: np.ndarray) -> float:
        y = self(x)
        a, p, n = (y[triplets[:, i]] for i in range(3))
        return float(np.maximum(np.linalg.norm(a - p, axis=1) - np.linalg.norm(a - n, axis=1) + self.config.margin, 0).mean())

    def fit(self, x: np.ndarray, triplets: np.ndarray) -> list[float]:
        """Gradient descent over the columns of two schemas, which are few; gives the loss of each epoch."""
        if not len(triplets):
            raise ValueError("there are no triplets to train on")
        history = []
        for _ in range(self.config.epochs):
            z = x @ self.weight
            norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            y = z / norm
            grad = np.zeros_like(y)
            a, p, n = (triplets[:, i] for i in range(3))
            ap, an = y[a] - y[p], y[a] - y[n]
            d_ap, d_an = (np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9) for d in (ap, an))
            on = (d_ap - d_an + self.config.margin > 0) / len(triplets)
            for at, g in ((a, ap / d_ap - an / d_an), (p, -ap / d_ap), (n, an / d_an)):
                np.add.at(grad, at, on * g)
            back = (grad - y * (grad * y).sum(1, keepdims=True)) / norm
            self.weight -= self.config.rate * x.T @ back
            history.append(self.loss(x, triplets))
        return history


def graph_layer(edges: DataFrame, nodes: DataFrame, weight: np.ndarray) -> DataFrame:
    """(id, v): each node's vector plus the linear image of its sources' mean, scaled to length one. No edge: no message."""
    dims = weight.shape[0]
    message = mean_message(edges, nodes, dims).withColumnRenamed("dst", "id")
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in column)) for column in weight.T))
    image = F.transform(rows, lambda w: F.aggregate(F.zip_with(F.col("message"), w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    joined = nodes.select("id", "v").join(message, "id", "left")
    moved = F.when(F.col("message").isNull(), F.col("v")).otherwise(F.zip_with("v", image, lambda x, y: x + y))
    return joined.select("id", l2_normalize(moved).alias("v"))
