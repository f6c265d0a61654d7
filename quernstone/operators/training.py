"""Training row models through their layers, in two ways that give the same gradients.

Full pass: every layer is a table, and the reverse pass goes through the same joins backwards. The gradient of a gather along edges is a
sum over the sources, that of the softmax a product that each edge's target holds already; both are grouped sums of vectors, one sum for each dimension, so what
moves is partial sums. Weight gradients are summed in each partition, then over the square root of their number, and a handful of vectors reach the driver.

Blocks: examples are dealt to blocks of bounded size, and each block fetches once what its rows need: their edges, at most fan_out of each by
hash, and the tokens and columns at these. The blocks are stored by runs of steps; an epoch reads each once and joins nothing. A step sums its blocks' gradients, clips them and
moves the weights by AdamW; the rate rises linearly, then falls as a cosine. Each example is in one block, so with no bound on the edges
a pass over all blocks sums to the gradient of the full pass. A step needs the weights of the one before. Where it has few blocks, a job for each would be
longer than its work, so a task takes a bounded run of steps and hands the weights and moments to the next; a step of many blocks is a job of its own, in as many tasks.

Tokens and columns send to rows, not back. Rows without edges keep what they are. Vectors, and a graph's ids, must not be null.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil, cos, isqrt, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.hashing import order_key
from quernstone.operators import layers as L
from quernstone.operators.rowmodel import vector_sum
from quernstone.sources.storage import Scratch

#: Column vectors of at most so many columns are broadcast along the edges.
BROADCAST_COLUMNS = 10_000
#: Steps of at most so many blocks follow each other in a task, and so many blocks make a run of them.
FEW_BLOCKS, RUN_BLOCKS = 8, 512


@dataclass(frozen=True)
class Graph:
    """rows, tokens, columns (id, v); edges (dst row, src token, col)."""

    rows: DataFrame
    tokens: DataFrame
    columns: DataFrame
    edges: DataFrame

    def shape(self, **more) -> L.ModelShape:
        dims = (len(t.select("v").first()[0]) for t in (self.rows, self.tokens, self.columns))
        return L.ModelShape(*dims, **more)


@dataclass(frozen=True)
class TrainConfig:
    """loss: "triplet" of (a, p, n), "pairs" of (a, b, label) by a classifier of differences, "contrast" of partners (a, b) among all rows of their block.

    batch: examples of a block; blocks: of a step; fan_out: edges of a row (None: all); warm_up: share of the epochs in which the rate rises.
    """

    loss: str = "contrast"
    margin: float = 0.3
    temperature: float = 0.1
    rate: float = 5e-3
    least_rate: float = 1e-6
    weight_decay: float = 1e-2
    clip: float = 1.0
    epochs: int = 10
    warm_up: float = 0.1
    batch: int = 256
    blocks: int = 8
    fan_out: int | None = 16
    patience: int = 5
    seed: int = 42


NAMES = {"triplet": ("a", "p", "n"), "pairs": ("a", "b"), "contrast": ("a", "b")}


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), np.ascontiguousarray(x, np.float64).ravel())


# Full pass


def local(df: DataFrame, keys: list[str], inputs: list[str], outputs: list[str], f: Callable, touched: list[str], like: L.Weights) -> DataFrame:
    """f of batches: {input: matrix} -> ({output: matrix}, gradients). Gives keys and outputs, and for each partition a row with the sum of the gradients of `touched`."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: L.Weights = {}
        names = [*keys, *outputs, "gradient"]
        for b in batches:
            if b.num_rows:
                out, more = f({c: matrix(b.column(c)) for c in inputs})
                L.added(total, more)
                if outputs:
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(arrays(out[c]) for c in outputs), pa.nulls(b.num_rows, pa.list_(pa.float64()))], names)
                kinds = [b.column(k).type for k in keys]
        if total and touched:
            vector = np.concatenate([total.get(k, np.zeros_like(like[k])).ravel() for k in touched])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), *(pa.nulls(1, pa.list_(pa.float64())) for _ in outputs), arrays(vector[None])], names)

    ddl = [*(f"{k} {types[k]}" for k in keys), *(f"{c} array<double>" for c in outputs), "gradient array<double>"]
    return df.select(*keys, *inputs).mapInArrow(run, ", ".join(ddl))


def vector_total(vectors: DataFrame) -> np.ndarray | None:
    """Sum of the vectors of the single column: in as many tasks as the square root of the shuffle partitions, then of these on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = matrix(b.column(0)).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([arrays(total[None])], ["v"])

    few = isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    sums = vectors.repartition(few).mapInArrow(run, "v array<double>").collect()  # a vector for each of a few tasks
    return np.sum([r["v"] for r in sums], axis=0) if sums else None


class FullPass:
    """Loss and gradients of examples over the whole graph, as tables. What does not depend on weights is made once."""

    def __init__(self, graph: Graph, shape: L.ModelShape):
        spark = graph.rows.sparkSession
        self.graph, self.shape, self.keep = graph, shape, Scratch(spark, "graph")
        self.edges = self.keep.store(graph.edges.select("dst", "src", "col"))
        degree = self.edges.groupBy("dst").agg(F.count("*").cast("double").alias("n"))
        rows = graph.rows.select("id", F.col("v").cast("array<double>").alias("v")).join(degree, F.col("id") == F.col("dst"), "left")
        self.rows = self.keep.store(rows.select("id", "v", F.array(F.coalesce("n", F.lit(0.0))).alias("n")))
        self.tokens, self.columns = (t.select("id", F.col("v").cast("array<double>").alias("v")) for t in (graph.tokens, graph.columns))
        self.few = graph.columns.count() <= BROADCAST_COLUMNS

    def made(self, df: DataFrame, keys: list[str], inputs: list[str], outputs: list[str], f: Callable, touched: tuple[str, ...] = ()) -> DataFrame:
        """local(), stored; its weight gradients are added to those of the pass."""
        out = self.scratch.store(local(df, keys, inputs, outputs, f, list(touched), self.w))
        if touched:
            total = vector_total(out.where("gradient is not null").select("gradient"))
            at = 0
            for k in touched if total is not None else ():
                L.added(self.found, {k: total[at : at + self.w[k].size].reshape(self.w[k].shape)})
                at += self.w[k].size
        return out.where("gradient is null").drop("gradient")

    def with_columns(self, edges: DataFrame, columns: DataFrame, name: str) -> DataFrame:
        named = columns.select(F.col("id").alias("col"), F.col("v").alias(name))
        return edges.join(F.broadcast(named) if self.few else named, "col")

    def zeros(self, c: str, dims: int) -> Column:
        return F.coalesce(c, F.array_repeat(F.lit(0.0), dims))

    def forward(self, w: L.Weights, scratch: Scratch) -> DataFrame:
        """(id, v): the rows' unit vectors. Layers stay for backward()."""
        self.w, self.scratch, self.found = {**w, "loss": np.zeros(1), "count": np.zeros(1)}, scratch, {}
        w, shape = self.w, self.shape
        value = lambda name: lambda x: ({"v": L.projected(w, name, x["v"])}, {})
        r = self.made(self.rows, ["id"], ["v"], ["v"], value("row"))
        self.h, self.e = self.made(self.tokens, ["id"], ["v"], ["v"], value("token")), self.made(self.columns, ["id"], ["v"], ["v"], value("column"))
        self.steps, width = [], shape.hidden + (shape.edge if shape.kind == "mean" else 0)
        n = self.rows.select("id", "n")
        if shape.kind == "mean":
            met = self.with_columns(self.edges.join(self.h.select(F.col("id").alias("src"), F.col("v").alias("h")), "src"), self.e, "e")
            total = met.groupBy("dst").agg(vector_sum(F.concat("h", "e"), width).alias("m"), F.count("*").alias("k"))
            mean = scratch.store(total.select(F.col("dst").alias("id"), F.transform("m", lambda x: x / F.col("k")).alias("m")))
        for k in range(shape.layers):
            edges = None
            if shape.kind == "mean":
                gathered = mean
            else:
                edges = self.attended(k, r)
                weighed = [F.sum(F.get("p", F.lit(i)) * F.get("alpha", F.lit(i * shape.heads // shape.hidden))) for i in range(shape.hidden)]
                gathered = edges.groupBy("dst").agg(F.array(*weighed).alias("m")).withColumnRenamed("dst", "id")
            state = r.withColumnRenamed("v", "r").join(n, "id").join(gathered, "id", "left").select("id", "r", "n", self.zeros("m", width).alias("m"))
            state = scratch.store(state)
            self.steps.append((state, edges))
            r = self.made(state, ["id"], ["r", "m", "n"], ["v"], lambda x, k=k: ({"v": L.row_layer(w, k, x["r"], x["m"], x["n"][:, 0])}, {}))
        self.last = r
        return self.made(r, ["id"], ["v"], ["v"], lambda x: ({"v": L.headed(w, x["v"])}, {}))

    def attended(self, k: int, r: DataFrame) -> DataFrame:
        """(dst, src, col, p, z, alpha) of layer k: each edge's source part, scored sum, and weights."""
        w, heads = self.w, self.shape.heads
        part = lambda t, key, name: self.made(t, ["id"], ["v"], ["v"], lambda x: ({"v": x["v"] @ w[f"{k}.{name}"]}, {})).select(F.col("id").alias(key), F.col("v").alias(name))
        met = self.edges.join(part(self.h, "src", "source"), "src").join(part(r, "dst", "target"), "dst")
        met = self.with_columns(met, part(self.e, "col", "edge").select(F.col("col").alias("id"), F.col("edge").alias("v")), "edge")

        def scored(x: dict) -> tuple[dict, dict]:
            z = x["source"] + x["target"] + x["edge"]
            return {"p": x["source"], "z": z, "s": L.edge_scores(w, k, z, heads)}, {}

        s = self.made(met, ["dst", "src", "col"], ["source", "target", "edge"], ["p", "z", "s"], scored)
        each = lambda f: F.array(*(f(F.get("s", F.lit(i))) for i in range(heads)))
        top = s.groupBy("dst").agg(each(F.max).alias("top"))
        s = s.join(top, "dst").withColumn("s", F.zip_with("s", "top", lambda x, t: F.exp(x - t))).drop("top")
        s = self.scratch.store(s)
        total = s.groupBy("dst").agg(each(F.sum).alias("total"))
        return self.scratch.store(s.join(total, "dst").select("dst", "src", "col", "p", "z", F.zip_with("s", "total", lambda x, t: x / t).alias("alpha")))

    def losses(self, y: DataFrame, examples: DataFrame, config: TrainConfig) -> DataFrame:
        """(id, v): the gradient of the summed loss by each row's vector."""
        names, w = NAMES[config.loss], self.w
        met = examples.withColumn("label", F.array(F.col("label").cast("double") if "label" in examples.columns else F.lit(1.0)))
        for c in names:
            met = met.join(y.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")), c)

        def run(x: dict) -> tuple[dict, dict]:
            vectors = [x[f"v_{c}"] for c in names]
            if config.loss == "triplet":
                loss, g = L.triplet_loss(vectors, config.margin)
                more = {}
            else:
                loss, g, more = L.pair_loss(w, vectors, x["label"][:, 0])
            return {f"g_{c}": v for c, v in zip(names, g, strict=True)}, more | {"loss": np.array([loss]), "count": np.array([float(len(vectors[0]))])}

        heads = ("pair.w", "pair.b", "pair.v", "pair.c") if config.loss == "pairs" else ()
        g = self.made(met, list(names), [*(f"v_{c}" for c in names), "label"], [f"g_{c}" for c in names], run, ("loss", "count", *heads))
        every = reduce(DataFrame.union, (g.select(F.col(c).alias("id"), F.col(f"g_{c}").alias("v")) for c in names))
        return every.groupBy("id").agg(vector_sum(F.col("v"), self.shape.output).alias("v"))

    def backward(self, dy: DataFrame) -> None:
        """Adds the gradients of all weights, from that of the rows' vectors."""
        w, shape = self.w, self.shape
        t = self.last.join(dy.withColumnRenamed("v", "g"), "id", "left").select("id", "v", self.zeros("g", shape.output).alias("g"))

        def head(x: dict) -> tuple[dict, dict]:
            g, more = L.headed_back(w, x["v"], x["g"])
            return {"v": g}, more

        dr = self.made(t, ["id"], ["v", "g"], ["v"], head, ("out.w", "out.b"))
        to_means, to_tokens, to_columns = [], [], []
        for k in reversed(range(shape.layers)):
            state, edges = self.steps[k]

            def layer(x: dict, k: int = k) -> tuple[dict, dict]:
                g, m, more = L.row_layer_back(w, k, x["r"], x["m"], x["n"][:, 0], x["g"])
                return {"v": g, "dm": m}, more

            own = [x for x in (f"{k}.w", f"{k}.b", f"{k}.gain", f"{k}.shift") if x in w]
            back = self.made(state.join(dr.withColumnRenamed("v", "g"), "id"), ["id"], ["r", "m", "n", "g"], ["v", "dm"], layer, tuple(own))
            dr = back.select("id", "v")
            if shape.kind == "mean":
                to_means.append(back.select("id", F.col("dm").alias("v")))
                continue
            met = edges.join(back.select(F.col("id").alias("dst"), "dm"), "dst").join(state.select(F.col("id").alias("dst"), "m"), "dst")

            def edge(x: dict, k: int = k) -> tuple[dict, dict]:
                dp, dz, more = L.edge_back(w, k, x["z"], x["p"], x["alpha"], x["dm"], x["m"])
                return {"dp": dp, "dz": dz}, more

            d = self.made(met, ["dst", "src", "col"], ["z", "p", "alpha", "dm", "m"], ["dp", "dz"], edge, (f"{k}.score",))

            def through(key: str, c: str, values: DataFrame, name: str, d: DataFrame = d) -> DataFrame:
                """The gradient of values (id, v), that W_name maps to what edges gather by key."""
                sums = d.groupBy(F.col(key).alias("id")).agg(vector_sum(F.col(c), shape.hidden).alias("g"))
                f = lambda x: ({"v": x["g"] @ w[name].T}, {name: x["v"].T @ x["g"]})
                return self.made(values.join(sums, "id"), ["id"], ["v", "g"], ["v"], f, (name,))

            to_tokens.append(through("src", "dp", self.h, f"{k}.source"))
            to_columns.append(through("col", "dz", self.e, f"{k}.edge"))
            dr = self.added_up([dr, through("dst", "dz", state.select("id", F.col("r").alias("v")), f"{k}.target")], shape.hidden)
        if shape.kind == "mean":
            share = self.added_up(to_means, shape.hidden + shape.edge).join(self.rows.select("id", "n"), "id")
            share = share.select(F.col("id").alias("dst"), F.transform("v", lambda x: x / F.greatest(F.get("n", F.lit(0)), F.lit(1.0))).alias("v"))
            d = self.scratch.store(self.edges.join(share, "dst").select("src", "col", "v"))
            to_tokens = [d.groupBy(F.col("src").alias("id")).agg(vector_sum(F.col("v"), shape.hidden).alias("v"))]
            tail = F.slice("v", shape.hidden + 1, shape.edge)
            to_columns = [d.groupBy(F.col("col").alias("id")).agg(vector_sum(tail, shape.edge).alias("v"))]
        for name, table, parts, dims in (("row", self.rows, [dr], shape.hidden), ("token", self.tokens, to_tokens, shape.hidden), ("column", self.columns, to_columns, shape.edge)):
            if parts:
                met = table.select("id", "v").join(self.added_up(parts, dims).withColumnRenamed("v", "g"), "id")
                own = tuple(f"{name}.{x}" for x in ("w", "b", "gain", "shift") if f"{name}.{x}" in w)
                self.made(met, ["id"], ["v", "g"], [], lambda x, name=name: ({}, L.projected_back(w, name, x["v"], x["g"])), own)

    def added_up(self, parts: list[DataFrame], dims: int) -> DataFrame:
        if len(parts) == 1:
            return parts[0]
        return self.scratch.store(reduce(DataFrame.union, parts).groupBy("id").agg(vector_sum(F.col("v"), dims).alias("v")))

    def gradient(self, w: L.Weights, examples: DataFrame, config: TrainConfig) -> tuple[float, float, L.Weights]:
        """Summed loss, number of examples, summed gradients. Contrast needs all rows at once: use blocks."""
        if config.loss == "contrast":
            raise ValueError("contrast has its negatives in blocks")
        scratch = Scratch(self.rows.sparkSession, "pass")
        y = self.forward(w, scratch)
        self.backward(self.losses(y, examples, config))
        loss, count = (float(self.found.pop(k, np.zeros(1))[0]) for k in ("loss", "count"))
        scratch.close()
        return loss, count, {k: self.found.get(k, np.zeros_like(v)) for k, v in w.items()}


# Blocks


def dealt(examples: DataFrame, config: TrainConfig) -> DataFrame:
    """examples with block: those of an anchor together, as far as a block's size allows, so that partners' partners meet."""
    names = NAMES[config.loss]
    total = examples.count()
    n = max(1, -(-total // config.batch))
    sizes = examples.groupBy("a").agg(F.ceil(F.count("*") / config.batch).alias("parts_"))
    part = F.pmod(F.xxhash64(*names), F.col("parts_"))
    return examples.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("a", part, F.lit(config.seed)), F.lit(n))).drop("parts_")


def pack(parts: dict[str, np.ndarray]) -> bytes:
    to = io.BytesIO()
    np.savez(to, **parts)
    return to.getvalue()


def assembled(table: pa.Table) -> pa.Table:
    """One row (step, block, data) of a block's rows: what it holds of vectors, edges and examples, as places."""
    kind = table.column("kind").to_numpy()
    names = {k: table.filter(pa.array(kind == k)).sort_by([("x", "ascending"), ("y", "ascending"), ("z", "ascending")]) for k in range(5)}
    parts, place = {}, {}
    for k, name in enumerate(("rows", "tokens", "columns")):
        t = names[k]
        place[name] = {x: i for i, x in enumerate(t.column("x").to_pylist())}
        v = t.column("v").combine_chunks()
        parts[name] = matrix(v) if len(t) else np.zeros((0, 0))
    at = lambda t, c, name: np.array([place[name][x] for x in t.column(c).to_pylist()], np.int64)
    e = names[3]
    parts |= {"dst": at(e, "x", "rows"), "src": at(e, "y", "tokens"), "col": at(e, "z", "columns")}
    x = names[4]
    parts |= {"a": at(x, "x", "rows"), "b": at(x, "y", "rows"), "label": x.column("label").to_numpy()}
    if len(x) and x.column("z")[0].is_valid:
        parts["c"] = at(x, "z", "rows")
    one = lambda c: table.column(c).slice(0, 1).combine_chunks()
    return pa.table({"step": one("step"), "block": one("block"), "data": pa.array([pack(parts)], pa.binary())})


def blocks(graph: Graph, examples: DataFrame, config: TrainConfig, scratch: Scratch) -> DataFrame:
    """(step, block, data, run), stored by run: a step of many blocks, or several steps of few. Ids may be of any type; in a block they are places."""
    names = NAMES[config.loss]
    text = lambda c: F.col(c).cast("string")
    label = F.col("label").cast("double") if "label" in examples.columns else F.lit(1.0)
    x = scratch.store(dealt(examples, config))
    steps = max(1, -(-max(1, -(-x.count() // config.batch)) // config.blocks))
    seeds = scratch.store(x.select("block", F.explode(F.array(*names)).alias("id")).distinct())
    edges = graph.edges.select("dst", "src", "col").join(seeds.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    if config.fan_out:
        order = W.partitionBy("dst").orderBy(order_key(config.seed, F.col("dst"), F.col("src"), F.col("col")), "src", "col")
        edges = edges.withColumn("k", F.row_number().over(order)).where(F.col("k") <= config.fan_out).drop("k")
    edges = scratch.store(edges.join(seeds.withColumnRenamed("id", "dst"), "dst").select("block", "dst", "src", "col"))
    none, vector = F.lit(None).cast("string"), lambda t: F.col("v").cast("array<double>")
    halo = lambda t, keys, key: keys.select("block", F.col(key).alias("id")).distinct().join(t.select("id", "v"), "id")
    kinds = [halo(graph.rows, seeds, "id"), halo(graph.tokens, edges, "src"), halo(graph.columns, edges, "col")]
    union = [t.select("block", F.lit(k).alias("kind"), text("id").alias("x"), none.alias("y"), none.alias("z"), vector(t).alias("v"), F.lit(0.0).alias("label")) for k, t in enumerate(kinds)]
    union.append(edges.select("block", F.lit(3), text("dst"), text("src"), text("col"), F.lit(None).cast("array<double>"), F.lit(0.0)))
    union.append(x.select("block", F.lit(4), text(names[0]), text(names[1]), text(names[2]) if len(names) == 3 else none, F.lit(None).cast("array<double>"), label))
    every = reduce(DataFrame.union, union).withColumn("step", F.pmod("block", F.lit(steps)).cast("int"))
    made = every.groupBy("step", "block").applyInArrow(assembled, "step int, block long, data binary")
    return scratch.store(made.withColumn("run", F.floor(F.col("step") / run_length(config)).cast("int")), by="run")


def run_length(config: TrainConfig) -> int:
    """Steps of a run."""
    return max(1, RUN_BLOCKS // config.blocks) if config.blocks <= FEW_BLOCKS else 1


def block_loss(w: L.Weights, shape: L.ModelShape, config: TrainConfig, data: bytes, back: bool) -> tuple[float, int, L.Weights]:
    """Summed loss, examples and gradients of a block."""
    d = np.load(io.BytesIO(data))
    if not len(d["a"]):
        return 0.0, 0, {}
    wide = lambda x, dims: x if x.shape[1] else np.zeros((0, dims))  # noqa: E731  a block without edges
    g = L.Subgraph(d["rows"], wide(d["tokens"], shape.token_dim), wide(d["columns"], shape.column_dim), d["dst"], d["src"], d["col"])
    y, steps = L.forward(w, shape, g)
    at, more = [d["a"], d["b"], d["c"]] if config.loss == "triplet" else [d["a"], d["b"]], {}
    if config.loss == "triplet":
        loss, parts = L.triplet_loss([y[i] for i in at], config.margin)
    elif config.loss == "pairs":
        loss, parts, more = L.pair_loss(w, [y[i] for i in at], d["label"])
    else:
        loss, dy = L.contrast_loss(y, d["a"], d["b"], config.temperature)
    if not back:
        return loss, len(d["a"]), {}
    if config.loss != "contrast":
        dy = sum(L.group_sum(p, i, len(y)) for p, i in zip(parts, at, strict=True))
    return loss, len(d["a"]), L.added(L.backward(w, shape, g, steps, dy), more)


def block_gradient(blocks_: DataFrame, w: L.Weights, shape: L.ModelShape, config: TrainConfig, back: bool = True) -> tuple[float, float, np.ndarray]:
    """Summed loss, examples and flat gradients over the blocks; a partition sends one sum."""
    size = sum(v.size for v in w.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + size * back)
        for b in batches:
            for data in b.column("data"):
                loss, n, more = block_loss(w, shape, config, data.as_py(), back)
                total[:2] += loss, n
                if more:
                    total[2:] += L.flat({k: more.get(k, np.zeros_like(v)) for k, v in w.items()})
        yield pa.RecordBatch.from_arrays([arrays(total[None])], ["v"])

    total = vector_total(blocks_.select("data").mapInArrow(run, "v array<double>"))
    total = np.zeros(2 + size * back) if total is None else total
    return float(total[0]), float(total[1]), total[2:]


def run_of_steps(blocks_: DataFrame, x: np.ndarray, moves: AdamW, rate: float, like: L.Weights, shape: L.ModelShape, config: TrainConfig) -> tuple[float, float, np.ndarray]:
    """Summed loss, examples and the weights after the steps of the blocks, which one task takes in order, a block at a time. moves goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, own, sums = None, x, deepcopy(moves), np.zeros(2)
        g, n = np.zeros_like(x), 0
        for b in batches:
            for step, data in zip(b.column("step").to_pylist(), b.column("data"), strict=True):
                if step != at:
                    w = own.moved(w, clipped(g / n, config.clip), rate) if n else w
                    at, weights, g, n = step, L.shaped(w, like), np.zeros_like(x), 0
                loss, k, more = block_loss(weights, shape, config, data.as_py(), True)
                if k:
                    g, n, sums = g + L.flat({name: more.get(name, np.zeros_like(v)) for name, v in like.items()}), n + k, sums + (loss, k)
        w = own.moved(w, clipped(g / n, config.clip), rate) if n else w
        yield pa.RecordBatch.from_arrays([arrays(np.concatenate([sums, [own.t], w, own.first, own.second])[None])], ["v"])

    ordered = blocks_.select("step", "block", "data").coalesce(1).sortWithinPartitions("step", "block")  # a bounded run
    v = np.array(ordered.mapInArrow(run, "v array<double>").first()["v"])
    moves.t, (x, moves.first, moves.second) = int(v[2]), np.split(v[3:], 3)
    return float(v[0]), float(v[1]), x


def rate_at(epoch: int, config: TrainConfig) -> float:
    """Linear up to the end of the warm-up, then a cosine down to the least rate. Epochs count from 1."""
    rising = max(1, int(config.epochs * config.warm_up))
    if epoch <= rising:
        return config.rate * epoch / rising
    return config.least_rate + (config.rate - config.least_rate) * (1 + cos(pi * (epoch - rising) / max(1, config.epochs - rising))) / 2


class AdamW:
    """Moments of the gradients; weights decay apart from them."""

    def __init__(self, size: int, decay: float, betas: tuple[float, float] = (0.9, 0.999)):
        self.first, self.second, self.t, self.decay, self.betas = np.zeros(size), np.zeros(size), 0, decay, betas

    def moved(self, x: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        b1, b2 = self.betas
        self.t += 1
        self.first, self.second = b1 * self.first + (1 - b1) * g, b2 * self.second + (1 - b2) * g * g
        step = self.first / (1 - b1**self.t) / (np.sqrt(self.second / (1 - b2**self.t)) + 1e-8)
        return x * (1 - rate * self.decay) - rate * step


def clipped(g: np.ndarray, most: float) -> np.ndarray:
    n = float(np.linalg.norm(g))
    return g * (most / n) if n > most else g


def made_blocks(sets: list[tuple[Graph, DataFrame]], config: TrainConfig, validation: list[tuple[Graph, DataFrame]] | None, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """The blocks of training and of validation, which don't depend on a model."""
    return [blocks(g, e, config, scratch) for g, e in sets], [blocks(g, e, config, scratch) for g, e in validation or []]


class RowModel:
    """Weights of a row model with their training."""

    def __init__(self, shape: L.ModelShape, seed: int = 42):
        self.shape, self.weights, self.history = shape, L.drawn(shape, seed), []

    def embeddings(self, graph: Graph, scratch: Scratch | None = None) -> DataFrame:
        """(id, v): unit vectors of the rows, over all their edges. They lie in the scratch folder, if one is given."""
        return FullPass(graph, self.shape).forward(self.weights, scratch or Scratch(graph.rows.sparkSession, "embeddings"))

    def fit(self, sets: list[tuple[Graph, DataFrame]], config: TrainConfig = TrainConfig(), validation: list[tuple[Graph, DataFrame]] | None = None, on_epoch: Callable[[int, dict], bool | None] | None = None, made: tuple[list[DataFrame], list[DataFrame]] | None = None) -> list[dict]:
        """Mini-batches over one or several data sets, one after the other in each epoch. Keeps the weights of the least validation loss (training loss without any).

        made: what made_blocks() gave for the same sets and config, if several models are trained on them.

        on_epoch gets the number and losses of each epoch; True from it ends the training, as do 2 * patience epochs without a better loss.
        """
        scratch = Scratch(sets[0][0].rows.sparkSession, "blocks")
        train, held = made or made_blocks(sets, config, validation, scratch)
        runs = [sorted(r["run"] for r in t.select("run").distinct().collect()) for t in train]
        if not any(runs):
            raise ValueError("there is nothing to train on")
        x, moves = L.flat(self.weights), AdamW(L.flat(self.weights).size, config.weight_decay)
        best, kept, waited = float("inf"), x, 0
        for epoch in range(1, config.epochs + 1):
            rate, loss, n = rate_at(epoch, config), 0.0, 0.0
            for t, own in zip(train, runs, strict=True):
                for r in own:
                    part = t.where(F.col("run") == r)
                    if config.blocks <= FEW_BLOCKS:
                        more, k, x = run_of_steps(part, x, moves, rate, self.weights, self.shape, config)
                    else:
                        more, k, g = block_gradient(part, L.shaped(x, self.weights), self.shape, config)
                        x = moves.moved(x, clipped(g / k, config.clip), rate) if k else x
                    loss, n = loss + more, n + k
            now = {"epoch": epoch, "rate": rate, "train": loss / max(n, 1.0)}
            sums = [block_gradient(t, L.shaped(x, self.weights), self.shape, config, back=False)[:2] for t in held]
            now["valid"] = sum(v for v, _ in sums) / max(sum(k for _, k in sums), 1.0) if held else now["train"]
            self.history.append(now)
            if now["valid"] < best - 1e-6:
                best, kept, waited = now["valid"], x, 0
            else:
                waited += 1
            if waited >= 2 * config.patience or on_epoch and on_epoch(epoch, now):
                break
        self.weights = L.shaped(kept, self.weights)
        scratch.close()
        return self.history

    def fit_full(self, graph: Graph, examples: DataFrame, config: TrainConfig, epochs: int) -> list[float]:
        """Whole-graph steps: each epoch one reverse pass through the tables."""
        whole, x, losses = FullPass(graph, self.shape), L.flat(self.weights), []
        moves = AdamW(x.size, config.weight_decay)
        for _ in range(epochs):
            loss, n, g = whole.gradient(L.shaped(x, self.weights), examples, config)
            losses.append(loss / max(n, 1.0))
            x = moves.moved(x, clipped(L.flat(g) / max(n, 1.0), config.clip), config.rate)
        self.weights = L.shaped(x, self.weights)
        return losses

    def save(self, spark: SparkSession, path: str) -> None:
        """One table: the shape and a row for each array of weights."""
        rows = [("shape", [], json.dumps(self.shape.__dict__), [])] + [(k, list(v.shape), None, v.ravel().tolist()) for k, v in self.weights.items()]
        spark.createDataFrame(rows, "name string, dims array<int>, shape string, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RowModel:
        rows = {r["name"]: r for r in spark.read.parquet(path).collect()}  # an array of weights each
        model = RowModel(L.ModelShape(**json.loads(rows["shape"]["shape"])))
        if set(model.weights) != set(rows) - {"shape"}:
            raise ValueError("the weights don't fit the shape")
        model.weights = {k: np.array(rows[k]["v"]).reshape(rows[k]["dims"]) for k in model.weights}
        return model


def halving(build: Callable[[dict], RowModel], train: Callable[[RowModel, dict, int], float], grid: dict[str, list], trials: int, path: str, spark: SparkSession, first: int = 1, keep: int = 3, rounds: int = 3, seed: int = 42) -> tuple[dict, DataFrame]:
    """The best choice from a grid by successive halving, and the table of all results (trial, round, epochs, choice, loss).

    All trials train `first` epochs; the best 1 / keep of them go on with keep times as many, for `rounds` rounds. Every result is appended to the table at path at once;
    a search that was broken off takes up what it finds there and asks for no result twice. train(model, choice, epochs) gives the validation loss.
    """
    rng, seen, choices = np.random.default_rng(seed), set(), []
    for _ in range(100 * trials):
        c = {k: v[int(rng.integers(len(v)))] for k, v in grid.items()}
        if len(choices) < trials and json.dumps(c) not in seen:
            seen.add(json.dumps(c))
            choices.append(c)
    ddl = "trial int, round int, epochs int, choice string, loss double"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    known = {(r["trial"], r["round"]): r for r in (spark.read.schema(ddl).parquet(path).collect() if there else [])}  # a row for each trial and round
    alive = list(range(len(choices)))
    for r in range(rounds):
        epochs, losses = first * keep**r, {}
        for k in alive:
            if (k, r) not in known:
                row = (k, r, epochs, json.dumps(choices[k]), float(train(build(choices[k]), choices[k], epochs)))
                spark.createDataFrame([row], ddl).write.mode("append").parquet(path)
                losses[k] = row[4]
            elif known[k, r]["choice"] != json.dumps(choices[k]):
                raise ValueError("the table is of another search")
            else:
                losses[k] = known[k, r]["loss"]
        alive = sorted(alive, key=lambda k: (losses[k], k))[: max(1, ceil(len(alive) / keep))]
    return choices[alive[0]], spark.read.schema(ddl).parquet(path)


def with_config(base: TrainConfig, text: str) -> TrainConfig:
    """base with the values of a JSON object."""
    return replace(base, **json.loads(text))
