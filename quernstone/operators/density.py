"""Density clusters by hierarchy: mutual reachability on the graph of near neighbours, a spanning forest, the condensed tree, all as tables.

Boruvka rounds find the forest: every component takes its shortest edge outwards. The same rounds give the merge tree. An edge taken in
round k is the shortest one of one or two components of that round, so in the tree these hang below it; and it goes into
the chain of edges that hangs below the first edge taken later that is longer than it. A chain is edges in order of
length, so sizes of subtrees are running sums along chains, with what hangs below each of their edges, from the first round to the last. Rounds are as many as the
logarithm of the rows; chains are cut into ranges; no task sees a component.

Of the tree, cut at a least size of clusters, only edges whose subtrees are that large count. Where both sides are, a cluster ends and two begin: the
edges between two such splits of a chain are one cluster, and a chain goes on with the cluster of the edge above it unless that is a split. Stability is
a sum over the edges of a cluster. What is left is a tree of clusters, two for each `smallest` rows at most; it is judged in one task while it has
MOST_CLUSTERS at most, and in rounds over a table beyond. Rows that no neighbour edge joins are in different clusters.

Several parameters are cut from one tree at once: their number is a key of every table. All tables grow with the rows and are met some hundred times, so
they are sorted and merged: small ones, broadcast each time, would all pass through the driver.

A search judges hundreds of choices, each in some hundred jobs over tables. Where edges and pairs, counted first, are few enough for a task's memory, it takes
a task for each choice instead, which has the whole tree as arrays and gives three numbers.
"""

from __future__ import annotations

import io
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators.graph import FEW_LINKS, connected_components
from quernstone.operators.ranking import globally_numbered, running_sums
from quernstone.sources.storage import Scratch, stored

#: Clusters of one choice of parameters that are judged in one task, 40 bytes each.
MOST_CLUSTERS = 100_000
#: Neighbours and pairs of a search, counted, of which a task has the tree of one choice in memory (by estimate 100 bytes each while it is made).
MOST_ROWS = 6_000_000
#: Length of an edge of no length.
SHORTEST = 1e-12


def reachability(near: DataFrame, samples: int) -> DataFrame:
    """(a, b, w): a < b, mutual reachability of neighbours. near (q, i, d, rank); the core distance is that to the samples-th neighbour."""
    core = near.where(F.col("rank") <= samples).groupBy("q").agg(F.max("d").alias("core"))
    met = near.join(core.hint("merge"), "q").join(core.select(F.col("q").alias("i"), F.col("core").alias("core_i")).hint("merge"), "i")
    e = met.select(F.least("q", "i").alias("a"), F.greatest("q", "i").alias("b"), F.greatest("d", "core", "core_i").alias("w"))
    return e.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"))


@dataclass(frozen=True)
class Rounds:
    """Of each round k: picks (v, a, b, w, x, y), the edge (a, b, w) that component v takes, between components x and y; ups (v, up), its component in round k + 1."""

    picks: list[DataFrame]
    ups: list[DataFrame]


def grown(edges: DataFrame, most_rounds: int = 40) -> Rounds:
    """The rounds that find a minimal spanning forest of edges (a, b, w). Each at least halves the components that still have edges outwards."""
    scratch, found = Scratch(edges.sparkSession, "forest"), Rounds([], [])
    open_ = scratch.store(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    for _ in range(most_rounds):
        e = F.struct("w", "a", "b", "x", "y")
        ends = open_.select(F.col("x").alias("v"), e.alias("e")).union(open_.select("y", e))
        picks = scratch.store(ends.groupBy("v").agg(F.min("e").alias("e")).select("v", "e.*"))
        if picks.isEmpty():
            return found
        ups = scratch.store(connected_components(picks.select(F.col("x").alias("a"), F.col("y").alias("b")), few=FEW_LINKS).select(F.col("id").alias("v"), F.col("component").alias("up")))
        found.picks.append(picks)
        found.ups.append(ups)
        for c in ("x", "y"):
            open_ = open_.join(ups.select(F.col("v").alias(c), F.col("up").alias(f"new {c}")).hint("merge"), c).withColumn(c, F.col(f"new {c}")).drop(f"new {c}")
        open_ = scratch.store(open_.where("x <> y"))
    raise RuntimeError("the forest did not settle")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): a minimal spanning forest of edges (a, b, w)."""
    picks = [p.select("a", "b", "w").distinct() for p in grown(edges).picks]
    return reduce(DataFrame.union, picks) if picks else edges.select("a", "b", "w").limit(0)


@dataclass(frozen=True)
class Tree:
    """edges (tree, e, w, k, v, above, most, least, below, size): in order of length, each in the chain (k, v) below the edge `above` (null: none); rows in the
    larger and the smaller part that hangs below it by itself (least is 0 if there is one), rows further down its chain, and all together.
    rows (tree, id, e): each row's first edge; rows that are in no edge are not there. Several trees can be one, by their number.
    """

    edges: DataFrame
    rows: DataFrame


def merge_tree(edges: DataFrame) -> Tree:
    """The tree of single linkage over edges (a, b, w), equal lengths in order of (a, b)."""
    spark, rounds = edges.sparkSession, grown(edges)
    scratch = Scratch(spark, "tree")
    if not rounds.picks:
        return Tree(spark.createDataFrame([], "tree int, e long, w double, k int, v long, above long, most long, least long, below long, size long"), spark.createDataFrame([], "tree int, id long, e long"))
    taken = reduce(DataFrame.union, (p.select("a", "b", "w", "x", F.lit(k).alias("round")).distinct() for k, p in enumerate(rounds.picks)))
    taken = scratch.store(globally_numbered(taken, F.col("w"), F.col("a"), F.col("b"), name="e"))
    number = taken.select("a", "b", "e")
    picks = [scratch.store(p.join(number.hint("merge"), ["a", "b"]).select("v", "e")) for p in rounds.picks]
    # Up from round to round, until a component's own edge is longer.
    waiting, chains = None, []
    for k, ups in enumerate(rounds.ups):
        entering = taken.where(F.col("round") == k).select("e", F.col("x").alias("v"))
        moved = (entering if waiting is None else waiting.union(entering)).join(ups.hint("merge"), "v").select("e", F.col("up").alias("v"))
        own = picks[k + 1].withColumnRenamed("e", "above") if k + 1 < len(picks) else spark.createDataFrame([], "v long, above long")
        moved = scratch.store(moved.join(own.hint("merge"), "v", "left").select("e", "v", "above"))
        last = F.col("above").isNull() | (F.col("e") < F.col("above"))
        chains.append(moved.where(last).select("e", F.lit(k + 1).alias("k"), "v", "above"))
        waiting = moved.where(~last).select("e", "v")
    chains = scratch.store(reduce(DataFrame.union, chains))
    # Sizes, first the parts below edges of round 0, which are rows; then each chain's, from edges of earlier rounds.
    parts = [scratch.store(picks[0].groupBy("e").agg(F.lit(1).cast("long").alias("most"), F.when(F.count("*") == 2, 1).otherwise(0).cast("long").alias("least")))]
    for k in range(1, len(picks)):
        sums = chains.where(F.col("k") == k).join(reduce(DataFrame.union, parts).hint("merge"), "e").groupBy("v").agg(F.sum(F.col("most") + F.col("least")).alias("size"))
        below = sums.join(picks[k].hint("merge"), "v").groupBy("e").agg(F.max("size").alias("most"), F.when(F.count("*") == 2, F.min("size")).otherwise(0).alias("least"))
        parts.append(scratch.store(below))
    every = chains.join(reduce(DataFrame.union, parts).hint("merge"), "e").join(taken.select("e", "w").hint("merge"), "e").withColumn("own", F.col("most") + F.col("least"))
    summed = running_sums(every, ["k", "v"], [F.col("e")], {"size": "own"}, many=True)
    edges = summed.select(F.lit(0).alias("tree"), "e", "w", "k", "v", "above", "most", "least", (F.col("size") - F.col("own")).alias("below"), "size")
    return Tree(scratch.store(edges), picks[0].select(F.lit(0).alias("tree"), F.col("v").alias("id"), "e"))


def together(trees: dict[int, Tree]) -> Tree:
    """Trees as one, their edges and chains numbered apart."""
    t, n = (lambda k: F.lit(k).alias("tree")), max(trees) + 1
    edges = [x.edges.select(t(k), (F.col("e") * n + k).alias("e"), "w", (F.col("k") * n + k).alias("k"), "v", (F.col("above") * n + k).alias("above"), "most", "least", "below", "size") for k, x in trees.items()]
    return Tree(reduce(DataFrame.union, edges), reduce(DataFrame.union, (x.rows.select(t(k), "id", (F.col("e") * n + k).alias("e")) for k, x in trees.items())))


@dataclass(frozen=True)
class Params:
    """smallest: rows of a cluster, 2 at least; samples: neighbours of a core; epsilon: distance below which clusters are not split; leaf: leaves in place of the most stable."""

    smallest: int = 15
    samples: int = 5
    epsilon: float = 0.0
    leaf: bool = False
    whole: bool = False  #: the root can be a cluster


def named(k: str, v: str, g: Column | str) -> Column:
    return F.concat_ws(":", F.col(k), F.col(v), g if isinstance(g, Column) else F.col(g))


def by_choice(rows: DataFrame, several: dict[int, Params], of: dict[int, int]) -> DataFrame:
    """rows (tree, ...) once for each choice that is about their tree, with choice and smallest."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("choice"), F.lit(p.smallest).alias("smallest"), F.lit(of.get(c, 0)).alias("tree of")) for c, p in several.items())))
    return rows.withColumn("c", each).where(F.col("c.tree of") == F.col("tree")).select("c.choice", "c.smallest", *(c for c in rows.columns if c != "tree"))


def condensed(tree: Tree, several: dict[int, Params], of: dict[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For each choice with its least size of clusters: (choice, smallest, e, k, v, size, cluster) of the edges with so large a subtree, and (choice, id, parent, birth, stability) of clusters."""
    large = by_choice(tree.edges, several, of).where("size >= smallest")
    sides = [F.col(c) for c in ("most", "least", "below")]
    split = (sum((x >= F.col("smallest")).cast("int") for x in sides) == 2).cast("int")
    falling = sum(F.when(x < F.col("smallest"), x).otherwise(0) for x in sides)
    large = large.withColumn("split", split).withColumn("mass", F.when(F.col("split") == 1, F.col("size")).otherwise(falling))
    large = running_sums(large, ["choice", "k", "v"], [F.desc("e")], {"upto": "split"}, many=True).withColumn("g", F.col("upto") - F.col("split")).drop("upto")
    large = scratch.store(large.withColumn("lam", 1 / F.greatest("w", F.lit(SHORTEST))))
    # Which cluster a chain begins with: its own below a split or at the top, else that of the edge above.
    tops = large.groupBy("choice", "k", "v", "above").agg(F.count("*").alias("n"))
    over = large.select("choice", F.col("e").alias("above"), F.col("k").alias("uk"), F.col("v").alias("uv"), F.col("g").alias("ug"), F.col("split").alias("us"), F.col("lam").alias("ulam"))
    tops = tops.join(over.hint("merge"), ["choice", "above"], "left")
    own = F.col("us").isNull() | (F.col("us") == 1)
    head = F.when(own, named("k", "v", F.lit(0))).when(F.col("ug") > 0, named("uk", "uv", "ug"))
    tops = scratch.store(tops.select("choice", "k", "v", "uk", "uv", "us", "ug", "ulam", head.alias("head")))
    known, open_ = tops.where("head is not null").select("choice", "k", "v", "head"), tops.where("head is null").select("choice", "k", "v", "uk", "uv")
    while not open_.isEmpty():  # a chain's upper one is of a later round
        up = known.select("choice", F.col("k").alias("uk"), F.col("v").alias("uv"), "head")
        step = scratch.store(open_.join(up.hint("merge"), ["choice", "uk", "uv"], "left"))
        known = known.union(step.where("head is not null").select("choice", "k", "v", "head"))
        open_ = step.where("head is null").drop("head")
    large = large.join(known.hint("merge"), ["choice", "k", "v"]).withColumn("cluster", F.when(F.col("g") > 0, named("k", "v", "g")).otherwise(F.col("head")))
    large = scratch.store(large)
    below = large.where((F.col("split") == 1) & (F.col("below") >= F.col("smallest"))).select("choice", named("k", "v", F.col("g") + 1).alias("id"), F.col("cluster").alias("parent"), F.col("lam").alias("birth"))
    hung = tops.where("us = 1").select("choice", named("k", "v", F.lit(0)).alias("id"), F.col("uk").alias("k"), F.col("uv").alias("v"), "ug", "ulam")
    hung = hung.join(known.hint("merge"), ["choice", "k", "v"]).select("choice", "id", F.when(F.col("ug") > 0, named("k", "v", "ug")).otherwise(F.col("head")).alias("parent"), F.col("ulam").alias("birth"))
    roots = tops.where("us is null").select("choice", named("k", "v", F.lit(0)).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("birth"))
    clusters = below.union(hung).union(roots)
    sums = large.join(clusters.select("choice", F.col("id").alias("cluster"), "birth").hint("merge"), ["choice", "cluster"]).groupBy("choice", F.col("cluster").alias("id")).agg(F.sum(F.col("mass") * (F.col("lam") - F.col("birth"))).alias("stability"))
    clusters = scratch.store(clusters.join(sums.hint("merge"), ["choice", "id"], "left").select("choice", "id", "parent", "birth", F.coalesce("stability", F.lit(0.0)).alias("stability")))
    return large.select("choice", "smallest", "e", "k", "v", "size", "cluster"), clusters


def judged(part: pd.DataFrame, p: Params) -> list[str | None]:
    """For each cluster the chosen one that it is in, or None: the most stable ones (or the leaves), none inside another."""
    at = {x: i for i, x in enumerate(part["id"])}
    parent = [at[x] if isinstance(x, str) else -1 for x in part["parent"]]
    ids = part["id"].tolist()
    return [ids[c] if c >= 0 else None for c in judged_places(parent, part["birth"].tolist(), part["stability"].tolist(), p)]


def judged_places(parent: list[int], birth: list[float], stability: list[float], p: Params) -> list[int]:
    """judged() of clusters by place; -1 is none."""
    below: list[list[int]] = [[] for _ in parent]
    for i, u in enumerate(parent):
        if u >= 0:
            below[u].append(i)
    down = [i for i, u in enumerate(parent) if u < 0]
    for i in down:  # grows: parents before children
        down += below[i]
    best, pick = stability[:], [not b for b in below]
    for i in reversed(down):
        if below[i] and not p.leaf:
            inner = sum(best[j] for j in below[i])
            pick[i] = stability[i] >= inner and (p.whole or parent[i] >= 0)
            best[i] = max(stability[i], inner) if pick[i] else inner
    chosen: list[int] = [-1] * len(down)
    for i in down:
        u = parent[i]
        if u >= 0 and chosen[u] >= 0:
            chosen[i] = chosen[u]
        elif pick[i] and (p.whole or u >= 0):
            chosen[i] = i
    if p.epsilon > 0:
        tops = set()
        for i in {c for c in chosen if c >= 0}:
            while parent[i] >= 0 and (p.whole or parent[parent[i]] >= 0) and birth[i] > 1 / p.epsilon:
                i = parent[i]
            tops.add(i)
        chosen = [-1] * len(down)
        for i in down:
            u = parent[i]
            chosen[i] = chosen[u] if u >= 0 and chosen[u] >= 0 else i if i in tops else -1
    return chosen


def judged_in_rounds(clusters: DataFrame, p: Params) -> DataFrame:
    """(id, chosen) as by judged(), for any number of clusters: up the tree by rounds, a level of it each, and down again."""
    scratch = Scratch(clusters.sparkSession, "clusters")
    counts = clusters.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    state = scratch.store(clusters.join(counts.hint("merge"), "id", "left").select("id", "parent", "birth", "stability", F.coalesce("n", F.lit(0)).alias("n")))
    done, waiting = state.where("n = 0").select("id", "parent", F.col("stability").alias("best"), F.lit(True).alias("pick")), state.where("n > 0")
    done = scratch.store(done)
    while not waiting.isEmpty():
        sums = done.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("seen"), F.sum("best").alias("inner"))
        ready = waiting.join(sums.hint("merge"), "id").where("seen = n")
        take = F.lit(False) if p.leaf else (F.col("stability") >= F.col("inner")) & (F.lit(p.whole) | F.col("parent").isNotNull())
        ready = scratch.store(ready.select("id", "parent", F.when(take, F.col("stability")).otherwise(F.col("inner")).alias("best"), take.alias("pick")))
        done = done.union(ready)
        waiting = scratch.store(waiting.join(ready.select("id").hint("merge"), "id", "left_anti"))

    def descended(first: DataFrame, rest: DataFrame, mine: Column) -> DataFrame:
        """(id, chosen): the parent's, or what mine says where it has none. first and rest have (id, parent, ...)."""
        level = scratch.store(first.withColumn("chosen", mine).select("id", "chosen"))
        found = level
        while not level.isEmpty():
            up = level.select(F.col("id").alias("parent"), F.col("chosen").alias("above"), F.lit(False).alias("top"))
            level = scratch.store(rest.join(up.hint("merge"), "parent").withColumn("chosen", F.coalesce("above", mine)).select("id", "chosen"))
            found = found.union(level)
        return found

    allowed = F.when(F.col("pick") & (F.lit(p.whole) | F.col("parent").isNotNull()), F.col("id"))
    flags = scratch.store(state.join(done.select("id", "pick").hint("merge"), "id"))
    roots, rest = flags.where("parent is null"), flags.where("parent is not null")
    chosen = scratch.store(descended(roots, rest, allowed))
    if p.epsilon <= 0:
        return chosen
    # Where a cluster that is split too low ends up: the first one above it that was born early enough, or below the root.
    up = flags.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
    stop = flags.join(up.hint("merge"), "parent", "left").withColumn("stays", (F.col("birth") <= 1 / p.epsilon) | F.col("parent").isNull() | (F.lit(not p.whole) & F.col("grand").isNull()))
    climbing = chosen.where("chosen is not null").select(F.col("chosen").alias("id")).distinct()
    tops = None
    while not climbing.isEmpty():
        now = scratch.store(climbing.join(stop.hint("merge"), "id").select("id", "parent", "stays"))
        found = now.where("stays").select("id")
        tops = found if tops is None else tops.union(found)
        climbing = now.where(~F.col("stays")).select(F.col("parent").alias("id")).distinct()
    if tops is None:
        return chosen
    marks = scratch.store(flags.join(tops.distinct().withColumn("in", F.lit(True)).hint("merge"), "id", "left"))
    mine = F.when(F.col("in"), F.col("id"))
    return descended(marks.where("parent is null"), marks.where("parent is not null"), mine)


def chosen_clusters(clusters: DataFrame, several: dict[int, Params], most: int = MOST_CLUSTERS) -> DataFrame:
    """(choice, cluster, chosen) for the clusters that are in a chosen one."""
    sizes = {r["choice"]: r["n"] for r in clusters.groupBy("choice").agg(F.count("*").alias("n")).collect()}  # a row for each choice

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = int(part["choice"].iloc[0])
        return pd.DataFrame({"choice": c, "cluster": part["id"], "chosen": judged(part, several[c])})

    few = [c for c, n in sizes.items() if n <= most]
    found = [clusters.where(F.col("choice").isin(few)).groupBy("choice").applyInPandas(run, "choice int, cluster string, chosen string")]
    for c in sizes.keys() - set(few):
        got = judged_in_rounds(clusters.where(F.col("choice") == c).drop("choice"), several[c])
        found.append(got.select(F.lit(c).alias("choice"), F.col("id").alias("cluster"), "chosen"))
    return reduce(DataFrame.union, found).where("chosen is not null")


def cut(tree: Tree, several: dict[int, Params], of: dict[int, int] | None = None, most: int = MOST_CLUSTERS) -> DataFrame:
    """(choice, id, cluster) for each of several parameters, of the rows that are in a cluster: its least id. of: the tree of each choice, 0 unless told."""
    scratch = Scratch(tree.edges.sparkSession, "cut")
    large, clusters = condensed(tree, several, of or {}, scratch)
    picked = scratch.store(chosen_clusters(clusters, several, most))
    # A row belongs to the cluster of the first edge above it whose subtree is large enough.
    first = scratch.store(large.groupBy("choice", "k", "v").agg(F.min("e").alias("first")))
    edges = tree.edges.select("e", "k", "v", "above", "size")
    rows, found = by_choice(tree.rows, several, of or {}), None
    while True:
        at = rows.join(edges.hint("merge"), "e").join(first.hint("merge"), ["choice", "k", "v"], "left")
        e = F.when(F.col("size") >= F.col("smallest"), F.col("e")).otherwise(F.col("first"))
        at = scratch.store(at.select("choice", "smallest", "id", e.alias("e"), "above"))
        here = at.where("e is not null").select("choice", "id", "e")
        found = here if found is None else found.union(here)
        rows = at.where("e is null and above is not null").select("choice", "smallest", "id", F.col("above").alias("e"))
        if rows.isEmpty():
            break
    labels = found.join(large.select("choice", "e", "cluster").hint("merge"), ["choice", "e"]).join(picked.hint("merge"), ["choice", "cluster"]).select("choice", "id", "chosen")
    labels = scratch.store(labels)
    names = labels.groupBy("choice", "chosen").agg(F.min("id").alias("cluster"))
    return labels.join(names.hint("merge"), ["choice", "chosen"]).select("choice", "id", "cluster")


def tree_of(near: DataFrame, samples: int) -> Tree:
    return merge_tree(reachability(near, samples))


def hdbscan(near: DataFrame, ids: DataFrame, params: Params = Params()) -> DataFrame:
    """(id, cluster) of all ids (id): the least id of the row's cluster, -1 for noise. near (q, i, d, rank): neighbours and distances.

    With all other rows as neighbours this is the hierarchy on the full graph; with k of them, edges of the spanning tree that no k nearest
    cross are missing, and what they would join stays apart.
    """
    labels = cut(tree_of(near, params.samples), {0: params})
    return ids.join(labels.hint("merge"), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


# Whole trees in tasks


def linkage(table: pa.Table) -> pa.Table:
    """One row (tree, data) of a tree's rows (tree, a, b, w, label): its merges in order of (w, a, b), as places, and pairs (no w) of which both rows are in an edge."""
    is_edge = table.column("w").is_valid().to_numpy()
    a, b = (table.column(c).to_numpy() for c in "ab")
    w, label = (table.column(c).fill_null(0).to_numpy() for c in ("w", "label"))
    pair_a, pair_b, label = a[~is_edge], b[~is_edge], label[~is_edge]
    a, b, w = a[is_edge], b[is_edge], w[is_edge]
    order = np.lexsort((b, a, w))
    ids = np.unique(np.concatenate([a, b]))
    n = len(ids)
    x, y, w = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order]), w[order]
    up, node, size = list(range(n)), list(range(n)), [1] * n
    taken, left, right, sizes = [], [], [], []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            if size[i] < size[j]:
                i, j = j, i
            taken.append(k)
            left.append(node[i])
            right.append(node[j])
            up[j], size[i], node[i] = i, size[i] + size[j], n + len(sizes)
            sizes.append(size[i])
    at, bt = (np.searchsorted(ids, c) for c in (pair_a, pair_b))
    both = (ids[np.minimum(at, n - 1)] == pair_a) & (ids[np.minimum(bt, n - 1)] == pair_b) if n else np.zeros(len(pair_a), bool)
    to = io.BytesIO()
    np.savez(to, ids=ids, w=w[taken], left=np.array(left, np.int32), right=np.array(right, np.int32), size=np.array(sizes, np.int32), a=at[both].astype(np.int32), b=bt[both].astype(np.int32), label=label[both].astype(np.int8))
    return pa.table({"tree": table.column("tree").slice(0, 1).combine_chunks(), "data": pa.array([to.getvalue()], pa.binary())})


def settled(up: np.ndarray) -> np.ndarray:
    """Where each place ends that goes to up[place]; ends go to themselves."""
    while True:
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further


def cut_whole(tree: dict[str, np.ndarray], p: Params) -> np.ndarray:
    """For each row of a tree as from linkage() the number of its chosen cluster, -1 for none. As cut(): nodes are the rows, then the merges."""
    n, m = len(tree["ids"]), len(tree["w"])
    size, lam = np.concatenate([np.ones(n, np.int64), tree["size"]]), np.concatenate([np.zeros(n), 1 / np.maximum(tree["w"], SHORTEST)])
    parent = np.arange(n + m)
    parent[tree["left"]] = parent[tree["right"]] = np.arange(n, n + m)
    sides = np.stack([size[tree["left"]], size[tree["right"]]])
    big = sides >= p.smallest
    split, large = np.zeros(n + m, bool), size >= p.smallest
    split[n:] = big.all(0)
    mass = np.concatenate([np.zeros(n), np.where(big.all(0), size[n:], np.where(big, 0, sides).sum(0))])
    # A cluster begins at the top and below a split, and goes down to the next one.
    heads = large & ((parent == np.arange(n + m)) | split[parent])
    heads[:n] = False
    nodes = np.flatnonzero(heads)
    number = np.full(n + m, -1)
    number[nodes] = np.arange(len(nodes))
    of = number[settled(np.where(heads | ~large, np.arange(n + m), parent))]
    top = parent[nodes] == nodes
    birth, above = np.where(top, 0.0, lam[parent[nodes]]), np.where(top, -1, of[parent[nodes]])
    some = np.flatnonzero(large)
    stability = np.bincount(of[some], mass[some] * (lam[some] - birth[of[some]]), len(nodes))
    chosen = np.append(np.array(judged_places(above.tolist(), birth.tolist(), stability.tolist(), p), np.int64), -1)  # the last is that of no cluster
    first = settled(np.where(large, np.arange(n + m), parent))[:n]
    return chosen[np.where(large[first], of[first], -1)]


def packed_trees(near: DataFrame, pairs: DataFrame, samples: list[int]) -> DataFrame:
    """(tree, data): linkage() for each number of samples, a task each."""
    none = F.lit(None).cast("double")
    each = [reachability(near, k).select(F.lit(k).alias("tree"), F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double"), F.lit(0).alias("label")) for k in samples]
    each += [pairs.select(F.lit(k).alias("tree"), F.col("a").cast("long"), F.col("b").cast("long"), none.alias("w"), F.col("label").cast("int").alias("label")) for k in samples]
    return stored(reduce(DataFrame.union, each).repartitionByRange(len(samples), "tree").groupBy("tree").applyInArrow(linkage, "tree int, data binary"))


def hits_whole(trees: DataFrame, several: dict[int, Params], of: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each choice the pairs in one cluster that are positive, all of them, and the rows of the largest cluster. trees as from packed_trees()."""
    choices = trees.sparkSession.createDataFrame([(c, of[c]) for c in several], "choice int, tree int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, data in zip(batch.column("choice").to_pylist(), batch.column("data"), strict=True):
                tree = dict(np.load(io.BytesIO(data.as_buffer())))
                own = cut_whole(tree, several[c])
                a = own[tree["a"]]
                hit = (a >= 0) & (a == own[tree["b"]])
                sizes = np.bincount(own[own >= 0], minlength=1)
                yield pa.RecordBatch.from_pydict({"choice": pa.array([c], pa.int32()), "tp": pa.array([int(tree["label"][hit].sum(dtype=np.int64))]), "n": pa.array([int(hit.sum())]), "m": pa.array([int(sizes.max())])})

    met = trees.join(F.broadcast(choices), "tree").select("choice", "data").repartition(len(several))  # a row for each choice
    return {r["choice"]: (r["tp"], r["n"], r["m"]) for r in met.mapInArrow(run, "choice int, tp long, n long, m long").collect()}


# The genes: least and most of each number; the last two are switches.
GENES = {"smallest": (2, 30), "samples": (1, 5), "epsilon": (0.0, 1.0), "leaf": (0, 1), "whole": (0, 1)}


def genetic_search(near: DataFrame, pairs: DataFrame, n_rows: int, size: int = 40, generations: int = 25, cross: float = 0.7, mutate: float = 0.2, beta: float = 1.0, giant: float = 0.5, penalty: float = 0.5, seed: int = 42, most: int = MOST_ROWS) -> list[tuple]:
    """(generation, params, best fitness, mean fitness). Fitness: F-beta of pairs (a, b, label) in one cluster, times the penalty if a cluster has more than
    the share `giant` of the rows. Tournaments of three, two-point crossover, mutation by redraw; the best survives. A generation's new
    parameters are judged in one job, and none twice; each in a task of its own while neighbours and pairs are `most` at most, and over tables beyond.
    """
    rng, trees, known = random.Random(seed), {}, {}
    pairs = stored(pairs.select("a", "b", "label"))
    whole = packed_trees(near, pairs, list(range(GENES["samples"][0], GENES["samples"][1] + 1))) if near.count() + pairs.count() <= most else None
    names = list(GENES)

    def drawn(name: str):
        low, high = GENES[name]
        return round(rng.uniform(low, high), 2) if isinstance(low, float) else rng.randint(low, high)

    def hits(several: dict[int, Params], of: dict[int, int]) -> dict[int, tuple[int, int, int]]:
        """hits_whole() over tables."""
        for samples in sorted(set(of.values()) - set(trees)):
            trees[samples] = tree_of(near, samples)
        labels = stored(cut(together({k: trees[k] for k in set(of.values())}), several, of))
        a, b = (labels.select("choice", F.col("id").alias(x), F.col("cluster").alias(f"c{x}")) for x in "ab")
        hit = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), ["choice", "b"]).where("ca = cb").groupBy("choice").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
        largest = labels.groupBy("choice", "cluster").agg(F.count("*").alias("m")).groupBy("choice").agg(F.max("m").alias("m"))
        return {r["choice"]: (r["tp"] or 0, r["n"] or 0, r["m"]) for r in largest.join(hit, "choice", "left").collect()}  # a row for each choice

    def judge(people: list[tuple]) -> None:
        new = sorted(set(people) - set(known))
        if not new:
            return
        several, of = {k: Params(p[0], p[1], p[2], bool(p[3]), bool(p[4])) for k, p in enumerate(new)}, {k: p[1] for k, p in enumerate(new)}
        got = hits(several, of) if whole is None else hits_whole(whole, several, of)
        for k, p in enumerate(new):
            tp, n, m = got.get(k, (0, 0, 0))
            precision, recall = tp / n if n else 0.0, tp / positive if positive else 0.0
            f = (1 + beta**2) * precision * recall / (beta**2 * precision + recall) if tp else 0.0
            known[p] = f * (penalty if m > giant * n_rows else 1.0)

    positive = pairs.agg(F.sum("label")).first()[0] or 0
    people = [tuple(drawn(n) for n in names) for _ in range(size)]
    out = []
    for g in range(generations):
        judge(people)
        best = max(people, key=lambda p: (known[p], p))
        out.append((g, best, known[best], sum(known[p] for p in people) / size))
        after = [best]
        while len(after) < size:
            x, y = (max(rng.sample(people, 3), key=lambda p: (known[p], p)) for _ in range(2))
            if rng.random() < cross:
                i, j = sorted(rng.sample(range(len(names) + 1), 2))
                x = x[:i] + y[i:j] + x[j:]
            after.append(tuple(drawn(n) if rng.random() < mutate else v for n, v in zip(names, x, strict=True)))
        people = after
    return out


def ranked(found: DataFrame) -> DataFrame:
    """(q, i, d, rank) of neighbours (q, i, sim) of unit vectors: Euclidean distances."""
    d = F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0)))
    return found.withColumn("d", d).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "i")))
