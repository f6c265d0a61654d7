"""A projector of column vectors, trained so that columns that belong together are nearer than others by a margin.

Linear, batch norm, GELU, dropout, linear, length one. The columns of all schemas are a table, and a step is over all of them. The norm's moments
are sums over partitions, and so are the two sums that its reverse needs: the gradient, and the gradient times the normalised value. A
step goes through the table four times (moments, vectors, gradients down to the norm, gradients below it); what reaches the driver is
sums of the weights' size. Dropout is by hash of the column's id, the step and the unit, so every pass of a step drops the same, wherever it runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import layers as L
from quernstone.operators.rowmodel import vector_sum
from quernstone.operators.training import AdamW, local, vector_total
from quernstone.sources.storage import Scratch

MOMENTUM = 0.1


@dataclass(frozen=True)
class ProjectorConfig:
    hidden: int = 64
    output: int = 32
    dropout: float = 0.1
    margin: float = 0.3
    rate: float = 5e-3
    weight_decay: float = 1e-4
    epochs: int = 50
    patience: int = 10
    seed: int = 42


def kept_units(ids: np.ndarray, step: int, units: int, config: ProjectorConfig) -> np.ndarray:
    """What dropout multiplies units by: 0, or 1 over the share that stays."""
    if not config.dropout or step < 0:
        return np.ones((len(ids), units))
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(units, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(step * 0x165667B1 + config.seed)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return (u >= config.dropout) / (1 - config.dropout)


class Projector:
    """Weights, running moments and training. Columns are (id long, v); other ids are numbered by their hash first (xxhash64)."""

    def __init__(self, dims: int, config: ProjectorConfig = ProjectorConfig()):
        rng, h, o = np.random.default_rng(config.seed), config.hidden, config.output
        self.config = config
        self.weights: L.Weights = {"in.w": rng.normal(size=(dims, h)) / np.sqrt(dims), "in.b": np.zeros(h), "gain": np.ones(h), "shift": np.zeros(h), "out.w": rng.normal(size=(h, o)) / np.sqrt(h), "out.b": np.zeros(o)}
        self.mean, self.spread = np.zeros(h), np.ones(h)
        self.history: list[dict[str, float]] = []

    def total(self, table: DataFrame, inputs: list[str], f, sizes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
        """Sums over the table of what f gives for batches."""
        like = {k: np.zeros(s) for k, s in sizes.items()}
        found = vector_total(local(table, ["id"], inputs, [], lambda x: ({}, f(x)), list(like), like).where("gradient is not null").select("gradient"))
        if found is None:
            return like
        out, at = {}, 0
        for k, v in like.items():  # in the order of the names given
            out[k] = found[at : at + v.size].reshape(v.shape)
            at += v.size
        return out

    def moments(self, columns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread of the first layer's values over all columns."""
        w, h = self.weights, self.config.hidden

        def f(x: dict) -> dict:
            z = x["v"] @ w["in.w"] + w["in.b"]
            return {"n": np.array([float(len(z))]), "s": z.sum(0), "q": (z * z).sum(0)}

        t = self.total(columns, ["v"], f, {"n": (1,), "s": (h,), "q": (h,)})
        n = max(t["n"][0], 1.0)
        return t["s"] / n, np.sqrt(np.maximum(t["q"] / n - (t["s"] / n) ** 2, 0) + L.EPS)

    def values(self, x: dict, mean: np.ndarray, spread: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
        """Normalised values, what goes into the GELU, what dropout leaves of it, and its factors."""
        w = self.weights
        c = (x["v"] @ w["in.w"] + w["in.b"] - mean) / spread
        u = c * w["gain"] + w["shift"]
        kept = kept_units(x["key"][:, 0].astype(np.int64), step, u.shape[1], self.config)
        return c, u, L.gelu(u) * kept, kept

    def project(self, columns: DataFrame, mean: np.ndarray | None = None, spread: np.ndarray | None = None, step: int = -1) -> DataFrame:
        """(id, v): unit vectors; by the running moments and without dropout unless told."""
        mean, spread = self.mean if mean is None else mean, self.spread if spread is None else spread
        me = self

        def f(x: dict) -> tuple[dict, dict]:
            return {"v": L.headed(me.weights, me.values(x, mean, spread, step)[2])}, {}

        return local(keyed(columns), ["id"], ["v", "key"], ["v"], f, [], {}).drop("gradient")

    def loss(self, triplets: DataFrame, y: DataFrame) -> tuple[float, float, DataFrame]:
        """Summed loss of triplets (a, p, n), how many there are, and (id, g), its gradient by each column's vector."""
        met, config = triplets, self.config
        for c in "apn":
            met = met.join(y.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")), c)

        def f(x: dict) -> tuple[dict, dict]:
            loss, g = L.triplet_loss([x[f"v_{c}"] for c in "apn"], config.margin)
            return {f"g_{c}": v for c, v in zip("apn", g, strict=True)}, {"loss": np.array([loss, len(x["v_a"])])}

        scratch = Scratch(y.sparkSession, "triplets")
        out = scratch.store(local(met.select(*(F.col(c).cast("long").alias(c) for c in "apn"), *(f"v_{c}" for c in "apn")), list("apn"), [f"v_{c}" for c in "apn"], [f"g_{c}" for c in "apn"], f, ["loss"], {"loss": np.zeros(2)}))
        sums = vector_total(out.where("gradient is not null").select("gradient"))
        rows = out.where("gradient is null")
        every = rows.select(F.col("a").alias("id"), F.col("g_a").alias("g")).union(rows.select("p", "g_p")).union(rows.select("n", "g_n"))
        grads = scratch.store(every.groupBy("id").agg(vector_sum(F.col("g"), config.output).alias("g")))
        return (0.0, 0.0, grads) if sums is None else (float(sums[0]), float(sums[1]), grads)

    def gradient(self, columns: DataFrame, triplets: DataFrame, step: int = 0) -> tuple[float, float, L.Weights, tuple[np.ndarray, np.ndarray]]:
        """Summed loss, triplets, summed gradients of all weights, and the moments that the norm used."""
        w, h, me = self.weights, self.config.hidden, self
        mean, spread = self.moments(columns)
        scratch = Scratch(columns.sparkSession, "projector")
        y = scratch.store(self.project(columns, mean, spread, step))
        loss, n, grads = self.loss(triplets, y)
        zero = F.array_repeat(F.lit(0.0), self.config.output)
        met = scratch.store(keyed(columns).join(grads, "id", "left").select("id", "v", "key", F.coalesce("g", zero).alias("g")))

        def below(x: dict) -> tuple[np.ndarray, np.ndarray, L.Weights]:
            """Normalised values, their gradient, and the weights' gradients above the norm."""
            c, u, left, kept = me.values(x, mean, spread, step)
            g, more = L.headed_back(me.weights, left, x["g"])
            g = g * kept * L.gelu_slope(u)
            return c, g * me.weights["gain"], more | {"gain": (g * c).sum(0), "shift": g.sum(0)}

        def upper(x: dict) -> dict:
            c, g, more = below(x)
            return more | {"sum": g.sum(0), "product": (g * c).sum(0), "count": np.array([float(len(c))])}

        sizes = {k: w[k].shape for k in ("out.w", "out.b", "gain", "shift")}
        t = self.total(met, ["v", "key", "g"], upper, sizes | {"sum": (h,), "product": (h,), "count": (1,)})
        total, product, count = t.pop("sum"), t.pop("product"), max(t.pop("count")[0], 1.0)

        def lower(x: dict) -> dict:
            c, g, _ = below(x)
            g = (g - total / count - c * product / count) / spread
            return {"in.w": x["v"].T @ g, "in.b": g.sum(0)}

        t |= self.total(met, ["v", "key", "g"], lower, {k: w[k].shape for k in ("in.w", "in.b")})
        scratch.close()
        return loss, n, t, (mean, spread)

    def fit(self, columns: DataFrame, triplets: DataFrame, held: DataFrame | None = None) -> list[dict[str, float]]:
        """Keeps the weights of the least loss of the held triplets (of the training loss without any); ends after `patience` epochs without a better one."""
        if triplets.isEmpty():
            raise ValueError("there are no triplets to train on")
        x, moves, best, kept, waited = L.flat(self.weights), AdamW(L.flat(self.weights).size, self.config.weight_decay), float("inf"), None, 0
        for step in range(self.config.epochs):
            loss, n, g, (mean, spread) = self.gradient(columns, triplets, step)
            first = not self.history
            self.mean = mean if first else (1 - MOMENTUM) * self.mean + MOMENTUM * mean
            self.spread = spread if first else (1 - MOMENTUM) * self.spread + MOMENTUM * spread
            now = {"train": loss / max(n, 1.0)}
            if held is not None:
                more, k, _ = self.loss(held, self.project(columns))
                now["valid"] = more / max(k, 1.0)
            self.history.append(now)
            judged = now.get("valid", now["train"])
            if judged < best - 1e-6:
                best, kept, waited = judged, (self.weights, self.mean, self.spread), 0
            else:
                waited += 1
                if waited >= self.config.patience:
                    break
            x = moves.moved(x, L.flat(g) / max(n, 1.0), self.config.rate)
            self.weights = L.shaped(x, self.weights)
        if kept:
            self.weights, self.mean, self.spread = kept
        return self.history


def keyed(columns: DataFrame) -> DataFrame:
    """With key, a hash of the id of 52 bits, which dropout goes by."""
    return columns.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.array(F.pmod(F.xxhash64("id"), F.lit(1 << 52)).cast("double")).alias("key"))
