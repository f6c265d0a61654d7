"""Centroid clustering by Lloyd's rounds that touch only what has changed.

Vectors are integers: floor(scale * component). The state is a stored table with a row for each vector: its components, its owner,
the squared distance to it and the owner before. The sums and counts of all clusters are kept beside it, k x dims integers. A round
makes the centroids anew from the sums and marks those that moved. Then a vector whose owner stayed is compared with the moved
centroids only, as all others are as far as they were; a vector whose owner moved is compared with all. Vectors that changed hands
send their components with a minus to the old cluster and with a plus to the new one, summed in each partition first, so a round
exchanges k rows for each task and the driver sees k rows. Nothing is exchanged by cluster or by vector, so large clusters are no hot keys. Distances
are exact: matrix products of doubles as long as all sums stay below 2 ** 52, else integers.

A lost executor costs tasks of one round: each round is written to the shared folder, and only the last one is kept.

Defined results: rows whose vector is null, has another number of components, or a component that is null, not finite or, scaled, beyond
2 ** 27 (64 squares of such differences fill a long) are left out. Of vectors with equal hashes of the id (repeated ids; a null id counts as the
empty text) the one with the smaller components starts first, and each repeated row gets a row. Fewer vectors than k give as many
clusters; an empty table gives an empty result. Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import quoted
from quernstone.sources.storage import Scratch

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, distance long, was int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that are kept, as integers."""
    v = quoted(vec_col).cast("array<double>")
    fits = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= LARGEST))
    return vectors.where(fits).select(quoted(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least hash: k rows on the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    largest = max(int(np.abs(x).max()), int(np.abs(c).max()), 1)
    if 4 * largest * largest * x.shape[1] < 1 << 52:
        product = x.astype(np.float64) @ c.T.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * product.astype(np.int64)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of each vector, given those before the moved centroids did so. Ties go to the smaller number. No owner: -1."""
    owner, distance = owner.copy(), distance.copy()
    free = owner < 0
    free[~free] = moved[owner[~free]]
    d = squares(x[free], centroids)
    owner[free] = d.argmin(1) if len(d) else 0
    distance[free] = d.min(1) if len(d) else 0
    number = np.flatnonzero(moved)
    if len(number) and not free.all():
        d = squares(x[~free], centroids[number])
        new, near, old, far = number[d.argmin(1)], d.min(1), owner[~free], distance[~free]
        nearer = (near < far) | (near == far) & (new < old)
        owner[~free], distance[~free] = np.where(nearer, new, old), np.where(nearer, near, far)
    return owner, distance


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after one comparison with what moved. Centroids go along with the tasks: k x dims numbers."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, distance = reassigned(matrix(b.column("v"), dims), was, b.column("distance").to_numpy(zero_copy_only=False), centroids, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32())], ["vec_id", "v", "cluster", "distance", "was"])

    return state.mapInArrow(run, STATE)


def transfers(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What clusters gained and lost in members and in components: signed sums over the vectors that changed hands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = matrix(b.column("v"), dims)
            for name, sign in (("cluster", 1), ("was", -1)):
                owner = b.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(owner[owner >= 0]):
                    mine = x[owner == c]
                    count[c] += sign * len(mine)
                    total[c] += sign * mine.sum(0)
        told = np.flatnonzero(count.astype(bool) | total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array(count[told]), pa.array(list(total[told]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    moves = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = moves.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dims))).alias("total"))
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in sums.collect():  # k rows at most
        count[r["cluster"]], total[r["cluster"]] = r["n"], r["total"]
    return count, total


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row for each kept vector: its cluster, the squared distance, the sums of distances of its cluster and of all, and a digest of its centroid."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col, vec_col, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    scratch = Scratch(spark, "lloyd")
    fresh = kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    state = scratch.store(assign(fresh, centroids, np.ones(len(centroids), bool)))
    count, total = transfers(state, len(centroids), dims)
    for _ in range(rounds):
        new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        moved = (new != centroids).any(1)
        if not moved.any():  # nothing would change any more
            break
        centroids = new
        state = scratch.store(assign(state, centroids, moved))
        scratch.keep_last()
        more, change = transfers(state, len(centroids), dims)
        count, total = count + more, total + change
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, d, sum(inertia.values()), digest[c]) for c, d in inertia.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
