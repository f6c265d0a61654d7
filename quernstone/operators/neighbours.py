"""Exact nearest neighbours and similarity joins in blocks.

Both sides are packed into blocks of a bounded number of vectors; each pair of blocks is one matrix product, and only the
best k of a query in a block, or what reaches the threshold, leaves it. Rows that move: blocks, not pairs of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.sources.storage import stored

#: Vectors of a block.
BLOCK = 2048


def blocks(df: DataFrame, id_col: str, vec_col: str, name: str, n: int, label_col: str | None = None) -> DataFrame:
    """(name_ids, name_vecs, name_labels): the vectors dealt to n blocks by a hash of their id, in order of id."""
    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    dealt = df.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), label.alias("label")).alias("x"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("block_"))
    packed = dealt.groupBy("block_").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return packed.select(F.col("block_").alias(f"{name}_block"), F.col("x.id").alias(f"{name}_ids"), F.flatten("x.v").alias(f"{name}_vecs"), F.col("x.label").alias(f"{name}_labels"))


def block_products(query: DataFrame, index: DataFrame, reducer, ddl: str, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, block: int = BLOCK, half: bool = False) -> DataFrame:
    """reduce(q_ids, i_ids, products, q_labels, i_labels) -> DataFrame, for each pair of blocks; reducer() gives each task a reduce of its own, which may overwrite the products.

    A task gets the pairs of a block of queries one after the other, as far as it has them. half: query and index are the same vectors, and
    each two blocks meet once.
    """
    n_q, n_i = (max(1, -(-d.count() // block)) for d in (query, index))
    met = blocks(query, id_col, vec_col, "q", n_q, label_col).crossJoin(blocks(index, id_col, vec_col, "i", n_i, label_col))
    if half:
        met = met.where("q_block <= i_block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reduce, room = reducer(), np.empty(0)
        for b in batches:
            for q_ids, q_vecs, q_labels, i_ids, i_vecs, i_labels in b[["q_ids", "q_vecs", "q_labels", "i_ids", "i_vecs", "i_labels"]].itertuples(index=False):
                q, i = np.asarray(q_ids), np.asarray(i_ids)
                if len(room) < len(q) * len(i):
                    room = np.empty(len(q) * len(i))
                sims = np.matmul(np.asarray(q_vecs).reshape(len(q), -1), np.asarray(i_vecs).reshape(len(i), -1).T, out=room[: len(q) * len(i)].reshape(len(q), len(i)))
                yield reduce(q, i, sims, np.asarray(q_labels), np.asarray(i_labels))

    return met.mapInPandas(run, ddl)


def cut_self(q: np.ndarray, i: np.ndarray, sims: np.ndarray) -> None:
    """A vector's product with itself becomes -inf. An id can be there more than once."""
    if len(np.unique(q)) == len(q) and len(np.unique(i)) == len(i):
        _, r, c = np.intersect1d(q, i, assume_unique=True, return_indices=True)
        sims[r, c] = -np.inf
    elif len(np.intersect1d(q, i)):
        cut_equal(q, i, sims)


def cut_equal(ql: np.ndarray, il: np.ndarray, sims: np.ndarray) -> None:
    """Products of equal labels become -inf; a missing label equals none."""
    rows, columns = (pd.Series(np.arange(len(x))).groupby(x).indices for x in (ql, il))
    for label, at in rows.items():
        if label in columns:
            sims[np.ix_(at, columns[label])] = -np.inf


#: Products that a task keeps for the queries it has met.
MOST_BEST = 4_000_000


class Chooser:
    """What leaves the products: the best k of each query with ties, what reaches the threshold, or both.

    Over the blocks that a block of queries meets in a task, each query keeps its k best products so far, and what is under the least of
    them stays behind. MOST_BEST bounds the products that are kept; beyond it the task begins anew.
    """

    def __init__(self, k: int | None, threshold: float | None, other: bool, unequal: bool = False):
        self.k, self.threshold, self.other, self.unequal, self.known = k, threshold, other, unequal, {}

    def __call__(self, q: np.ndarray, i: np.ndarray, sims: np.ndarray, ql: np.ndarray, il: np.ndarray) -> pd.DataFrame:
        if self.other:
            cut_self(q, i, sims)
        if self.unequal:
            cut_equal(ql, il, sims)
        if self.k is None:
            keep = np.isfinite(sims) if self.threshold is None else sims >= self.threshold
            r, c = np.nonzero(keep)
            return pd.DataFrame({"q": q[r], "i": i[c], "sim": sims[r, c]})
        at = (len(q), int(q[0]), int(q[-1])) if len(q) else ()
        (known, best), seen = self.known.get(at, (None, None)), 0
        if known is None or not np.array_equal(q, known):
            if sum(x.size for _, x in self.known.values()) > MOST_BEST:
                self.known.clear()
            some = max(256, 8 * self.k)  # the best of the first columns are a bound for those of all
            first = self.k < some < len(i)
            best = -np.partition(-sims[:, :some], self.k - 1, axis=1)[:, : self.k] if first else np.full((len(q), self.k), -np.inf)
            seen = some if first else 0
        r, c, v = self.above(sims, best)
        new = c >= seen
        rows, values = np.r_[np.repeat(np.arange(len(q)), self.k), r[new]], np.r_[best.ravel(), v[new]]
        order = np.lexsort((-values, rows))
        starts = np.searchsorted(rows[order], np.arange(len(q)))
        best = values[order][starts[:, None] + np.arange(self.k)]
        self.known[at] = q, best
        among = v >= best.min(axis=1)[r]
        return self.out(q, i, r[among], c[among], v[among])

    @staticmethod
    def above(sims: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and values that are not under the least of the best so far."""
        r, c = np.divmod(np.flatnonzero(sims >= best.min(axis=1)[:, None]), sims.shape[1])
        return r, c, sims[r, c]

    def out(self, q: np.ndarray, i: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        some = np.isfinite(v) if self.threshold is None else v >= self.threshold
        return pd.DataFrame({"q": q[r[some]], "i": i[c[some]], "sim": v[some]})


def packed_blocks(df: DataFrame, id_col: str, vec_col: str, name: str, n: int, label_col: str | None = None) -> DataFrame:
    """(name_ids, name_vecs, name_labels) of blocks(), as bytes and stored, so that a block is made once however many others it meets. A missing label is the least long."""
    kind = np.float32 if dict(df.dtypes)[vec_col] == "array<float>" else np.float64
    names = [f"{name}_ids", f"{name}_vecs", f"{name}_labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, v, labels in zip(*(b.column(c) for c in names), strict=True):
                parts = (ids.values.to_numpy(), v.values.to_numpy().astype(kind), labels.values.fill_null(NO_LABEL).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], names)

    return stored(blocks(df, id_col, vec_col, name, n, label_col).select(*names).mapInArrow(run, ", ".join(f"{c} binary" for c in names)))


#: Stands for a missing label, which equals none.
NO_LABEL = -(1 << 63)
#: Rows of a block whose products are made at a time, so that these stay in the processor's cache.
TILE = 256


def exact(q: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two matrices as doubles, added in order of the dimensions."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d].astype(np.float64) * i[:, d]
    return total


def places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that is nearly everywhere false: by words of eight."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])


def cut_labels(ql: np.ndarray, il: np.ndarray, sims: np.ndarray) -> None:
    """cut_equal() of labels of packed blocks."""
    columns = pd.Series(np.arange(len(il))).groupby(il).indices
    for label, at in pd.Series(np.arange(len(ql))).groupby(ql).indices.items():
        if label in columns and label != NO_LABEL:
            sims[np.ix_(at, columns[label])] = -np.inf


class Best:
    """The best k of a block of queries over the blocks that it meets: values and ids, best first, least id first among equal values.

    Products are made as floats; what is not under the least of the best so far by more than twice the error that their sum can have is made again as a
    double, by which it is judged. Vectors whose products a float can't hold are doubles from the start.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, labels: np.ndarray, k: int, threshold: float | None, other: bool, unequal: bool):
        self.ids, self.v, self.labels, self.k, self.other, self.unequal = ids, v, labels, k, other, unequal
        self.least = -np.inf if threshold is None else threshold
        self.values, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))

    def meet(self, ids: np.ndarray, v: np.ndarray, labels: np.ndarray) -> None:
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        most = max(self.norms.max(), norms.max())
        kind = np.float32 if most < 1e18 else np.float64  # no, if it is no number
        error = (v.shape[1] + 4) * float(np.finfo(kind).eps) * self.norms * norms.max() + 1e-30
        across, columns = v.astype(kind).T, max(256, 8 * self.k)
        met = self.other and np.isin(self.ids, ids).any()
        for at in range(0, len(self.ids), TILE):
            rows = slice(at, at + TILE)
            sims = np.matmul(self.v[rows].astype(kind), across)
            if met:
                cut_self(self.ids[rows], ids, sims)
            if self.unequal:
                cut_labels(self.labels[rows], labels, sims)
            bound = np.maximum(self.values[rows, -1], self.least)
            if self.k < columns < len(ids) and np.isneginf(bound).any():  # the best of the first columns are a bound for those of all
                bound = np.maximum(bound, -np.partition(-sims[:, :columns], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) - error[rows])
            low = (bound - error[rows]).astype(kind)
            low = np.where(low > bound - error[rows], np.nextafter(low, kind(-np.inf)), low)
            r, c = np.divmod(places(sims >= low[:, None]), len(ids))
            some = np.isfinite(sims[r, c])
            self.take(r[some] + at, c[some], ids, v)

    def take(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Pairs that may be among the best."""
        values = np.concatenate([exact(self.v[r[x : x + BLOCK]], v[c[x : x + BLOCK]]) for x in range(0, len(r), BLOCK)]) if len(r) else np.zeros(0)
        some = (values >= self.least) & (values >= self.values[r, -1]) & np.isfinite(values)
        r, c, values = r[some], c[some], values[some]
        if not len(r):
            return
        rows = np.unique(r)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), np.searchsorted(rows, r)])
        values, found = np.concatenate([self.values[rows].ravel(), values]), np.concatenate([self.found[rows].ravel(), ids[c]])
        order = np.lexsort((found, -values, at))
        first = order[np.searchsorted(at[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.values[rows], self.found[rows] = values[first], found[first]

    def out(self) -> pa.RecordBatch:
        some = self.values > -np.inf
        q = np.repeat(self.ids[:, None], self.k, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(q[some], pa.int64()), pa.array(self.found[some], pa.int64()), pa.array(self.values[some])], ["q", "i", "sim"])


def best_of_blocks(query: DataFrame, index: DataFrame, k: int, threshold: float | None, other: bool, id_col: str, vec_col: str, label_col: str | None, block: int) -> DataFrame:
    """(q, i, sim): for each query the best k of the blocks of the index that a task has."""
    same = query is index
    n_q = max(1, -(-query.count() // block))
    n_i = n_q if same else max(1, -(-index.count() // block))
    q = packed_blocks(query, id_col, vec_col, "q", n_q, label_col)
    i = q.toDF("i_ids", "i_vecs", "i_labels") if same else packed_blocks(index, id_col, vec_col, "i", n_i, label_col)
    kinds = {c: np.float32 if dict(t.dtypes)[vec_col] == "array<float>" else np.float64 for c, t in (("q", query), ("i", index))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = None, None

        def matrices(b: pa.RecordBatch, at: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, v, labels = (np.frombuffer(b.column(f"{name}_{c}")[at].as_buffer(), t) for c, t in (("ids", np.int64), ("vecs", kinds[name]), ("labels", np.int64)))
            return ids, v.reshape(len(ids), -1), labels

        for b in batches:
            for at in range(b.num_rows):
                own = b.column("q_ids")[at].as_buffer()
                if best is None or not own.equals(ids):  # a block of queries meets all blocks that the task has one after the other
                    if best is not None:
                        yield best.out()
                    copies = [x.copy() for x in matrices(b, at, "q")]
                    best, ids = Best(*copies, k, threshold, other, label_col is not None), pa.py_buffer(copies[0])
                best.meet(*matrices(b, at, "i"))
        if best is not None:
            yield best.out()

    return q.crossJoin(i.hint("shuffle_replicate_nl")).mapInArrow(run, "q long, i long, sim double")


def similar(query: DataFrame, index: DataFrame, k: int | None = None, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", other: bool = False, block: int = BLOCK, unequal: str | None = None) -> DataFrame:
    """(q, i, sim): dot products; the best k of each query (ties by id), those at or above the threshold, or both.

    other: a vector is no neighbour of itself. unequal: nor of one with the same value of that column, a long. Exact, so the work is the product
    of both sides; CellIndex is for large ones.
    """
    if k is not None:
        return best_k(best_of_blocks(query, index, k, threshold, other, id_col, vec_col, unequal, block), k)
    return block_products(query, index, lambda: Chooser(k, threshold, other, unequal is not None), "q long, i long, sim double", id_col, vec_col, unequal, block)


def best_k(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the best k of each query."""
    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "i"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


#: Powers of e by which a row's or a column's greatest product may be under its block's, in one exponential for both.
SPREAD = 600.0


def log_sum_exp(vectors: DataFrame, temperature: float, block: int = BLOCK) -> DataFrame:
    """(q, total) of each vector: log of the sum of exp(product / temperature) over all others. Two blocks meet once, and give a maximum and a sum for each vector of both."""

    def sums(ids: np.ndarray, z: np.ndarray, axis: int) -> pd.DataFrame:
        top = z.max(axis=axis, keepdims=True)
        safe = np.where(np.isfinite(top), top, 0.0)
        return pd.DataFrame({"q": ids, "top": safe.ravel(), "part": np.exp(z - safe).sum(axis=axis)})

    def reduce(q: np.ndarray, i: np.ndarray, z: np.ndarray, *_) -> pd.DataFrame:
        z /= temperature
        same = np.array_equal(q, i)
        cut_self(q, i, z)
        rows, columns = z.max(axis=1), z.max(axis=0)
        most = rows.max()
        if not np.isfinite(rows).all() or not np.isfinite(columns).all() or min(rows.min(), columns.min()) < most - SPREAD:
            return sums(q, z, 1) if same else pd.concat([sums(q, z, 1), sums(i, z, 0)])
        z -= most
        np.exp(z, out=z)
        ids, part = (q, z.sum(axis=1)) if same else (np.r_[q, i], np.r_[z.sum(axis=1), z.sum(axis=0)])
        return pd.DataFrame({"q": ids, "top": most, "part": part})

    parts = block_products(vectors, vectors, lambda: reduce, "q long, top double, part double", block=block, half=True)
    most = parts.groupBy("q").agg(F.max("top").alias("most"))
    return parts.join(most, "q").groupBy("q").agg((F.max("most") + F.log(F.sum(F.col("part") * F.exp(F.col("top") - F.col("most"))))).alias("total"))


def best_of_other_label(query: DataFrame, index: DataFrame, label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(q, i, sim): the most similar vector of another label, the least id of equal ones. A block gives one row for each query."""

    def reduce(q: np.ndarray, i: np.ndarray, sims: np.ndarray, ql: np.ndarray, il: np.ndarray) -> pd.DataFrame:
        cut_equal(ql, il, sims)
        at = sims.argmax(axis=1)  # ids of a block are in order, so the first of equal ones
        best = sims[np.arange(len(q)), at]
        return pd.DataFrame({"q": q, "i": i[at], "sim": best})[np.isfinite(best)]

    found = block_products(query, index, lambda: reduce, "q long, i long, sim double", label_col=label_col, block=block)
    return found.groupBy("q").agg(F.max_by(F.struct("i", "sim"), F.struct(F.col("sim"), -F.col("i"))).alias("b")).select("q", "b.i", "b.sim")


class CellIndex:
    """Approximate neighbours for large tables: every vector lies in the cell of its nearest centroid, a query looks into `probes` cells.

    Centroids are fitted on a sample of at most `sample` vectors; every row is assigned. Cells are cut into blocks of a bounded
    number of vectors, so a crowded cell is many tasks. tests/test_operators.py measures the recall against the exact path.
    """

    def __init__(self, index: DataFrame, cells: int, probes: int, sample: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.id_col, self.vec_col, self.probes = id_col, vec_col, probes
        some = index.orderBy(F.xxhash64(id_col)).limit(sample).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
        self.centroids = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(some).clusterCenters())  # `cells` rows at most
        self.index = self.assigned(index, 1)

    def assigned(self, df: DataFrame, n: int) -> DataFrame:
        """(id, v, cell): each vector with its n nearest cells."""
        centroids = self.centroids
        norms = (centroids**2).sum(axis=1)
        n = min(n, len(centroids))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(norms[None, :] - 2 * np.vstack(b["v"].to_list()) @ centroids.T, axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "v": [v for v in b["v"] for _ in range(n)], "cell": near.ravel()})

        rows = df.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).cast("array<double>").alias("v"))
        return rows.mapInPandas(run, "id long, v array<double>, cell int")

    def search(self, query: DataFrame, k: int, other: bool = False, block: int = BLOCK) -> DataFrame:
        """(q, i, sim, rank): the best k of each query among the vectors of its cells."""

        def packed(rows: DataFrame, name: str) -> DataFrame:
            sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
            dealt = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # a row for each cell
            x = dealt.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("x"))
            return x.select("cell", F.col("x.id").alias(f"{name}_ids"), F.flatten("x.v").alias(f"{name}_vecs"))

        met = packed(self.assigned(query, self.probes), "q").join(packed(self.index, "i"), "cell")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for q_ids, q_vecs, i_ids, i_vecs in zip(b.q_ids, b.q_vecs, b.i_ids, b.i_vecs, strict=True):
                    q, i = np.asarray(q_ids), np.asarray(i_ids)
                    yield Chooser(k, None, other)(q, i, np.asarray(q_vecs).reshape(len(q), -1) @ np.asarray(i_vecs).reshape(len(i), -1).T, q, i)

        return best_k(met.mapInPandas(run, "q long, i long, sim double"), k)


def pair_scores(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """pairs with score: the dot product of their vectors."""
    from quernstone.functions.vectors import dot

    left = vectors.select(F.col(id_col).alias(a), F.col(vec_col).cast("array<double>").alias("va_"))
    right = vectors.select(F.col(id_col).alias(b), F.col(vec_col).cast("array<double>").alias("vb_"))
    return pairs.join(left, a).join(right, b).withColumn("score", dot(F.col("va_"), F.col("vb_"))).drop("va_", "vb_")
