"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

The leaves of a tree (domain, language, source) hold documents. A token budget goes down the tree: at each node it is
split among the children by weight; a child gets no more than its subtree can give (tokens times the allowed epochs), and
what it cannot take goes to its siblings in proportion to their weights. A subtree's limit is known before its parent
splits, so siblings make up a shortage first and only what a whole subtree lacks goes to the ancestors' other children.
Each leaf then takes a prefix, in tokens, of its seeded epochs: whole permutations of its documents as often as the
budget holds them, then the first documents of the next permutation, as long as their sum stays within the budget.

The order of a permutation is that of a seeded hash, so a leaf's prefix is all rows up to a cut-off hash: only the ids and
token counts are sorted, the texts are filtered where they lie. Running sums over a leaf never sort the leaf in one task: documents fall into buckets by the first digits of their
hash, the sums of the buckets are added up first, and each bucket is then sorted by itself.

Defined results: a null in a path column is a child named ''; a null count is 0 tokens, and a document without tokens is
taken whenever the prefix reaches its place; a null doc_id hashes as 'null'; rows with one doc_id in one leaf are taken
together or not at all in an epoch; an empty table gives an empty result; a leaf without a weight gets the
weight 1; clashing names of added columns get underscores in front.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, fresh, quoted

SEED = 42
MAX_EPOCHS = 2
#: The budget as a share of all tokens.
SHARE = 0.6
#: Rows of a leaf that are added up one by one in the end.
BUCKET_ROWS = 100_000

#: The production tree: weights of domains and of languages in each domain; sources weigh the same.
DOMAINS = {"web": 0.4, "books": 0.3, "code": 0.2, "talk": 0.1}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def weights(values: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double"), F.lit(1.0))


def filled(nodes: DataFrame, parents: list[str], name: str, budget: Column) -> DataFrame:
    """nodes (parents..., name, weight, capacity) with budget: the parent's split among its children by weight under their capacities.

    Children are put in order of capacity / weight. While those before it are full, a child at its place would get level *
    weight; the first child whose capacity is not reached fixes the level for all after it. Levels further on are lower, so it is the highest.
    """
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = by.orderBy(F.coalesce(F.col("capacity") / F.nullif(F.col("weight"), F.lit(0.0)), F.lit(0.0)), name)  # weight 0: capacity 0
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = F.greatest(budget - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.lit(0.0)) / F.nullif(rest, F.lit(0.0))
    nodes = nodes.withColumn("level", level)
    nodes = nodes.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("capacity"), F.col("level"))).over(by))
    return nodes.withColumn("budget", F.least(F.col("capacity"), F.coalesce(F.col("level") * F.col("weight"), F.col("capacity")))).drop("level")


def leaf_budgets(leaves: DataFrame, path: list[str], level_weights: list[dict[str, float]], share: float, max_epochs: int) -> DataFrame:
    """leaves (path..., tokens) with budget, in whole tokens. The tables here have a row for each node of the tree.

    What has weight 0, or is below such a node, has no capacity: its siblings get its share, and its ancestors count only what is wanted.
    """
    if any(not 0 <= w < math.inf for level in level_weights for w in level.values()):
        raise ValueError("weights must be numbers from 0")
    wanted = reduce(Column.__and__, (weights(w, F.col(name)) > 0 for w, name in zip(level_weights, path, strict=True)))
    nodes = leaves.withColumn("capacity", F.when(wanted, F.col("tokens").cast("double") * max_epochs).otherwise(0.0))
    total = F.floor(F.sum("tokens").over(W.partitionBy(F.lit(0))) * F.lit(float(share))).cast("double")
    current = None
    for depth, name in enumerate(path):
        own = path[: depth + 1]
        level = nodes.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", weights(level_weights[depth], F.col(name)))
        if current is None:
            current = filled(level, [], name, total)
        else:
            above = current.select(*path[:depth], F.col("budget").alias("above"))
            current = filled(level.join(above, path[:depth]), path[:depth], name, F.col("above")).drop("above")
    return current.select(*path, "tokens", F.floor(F.round("budget", 3)).cast("long").alias("budget"))


#: A plan of at most so many leaves is broadcast (its rows are short); beyond that it is joined by key.
BROADCAST_LEAVES = 50_000


def cut_offs(slim: DataFrame, plan: DataFrame, levels: list[str], seed: int, few: bool, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """plan with cut: the largest hash of the prefix of the leaf's partial epoch (null: nothing of it is taken). few: plan may be broadcast.

    The hash where the budget runs out is narrowed down by two hexadecimal digits at a time: 256 sums for each leaf, of which one bucket
    goes on, until a bucket of the largest leaf has about bucket_rows rows; these are added up one by one.
    """
    rounds, most = 1, slim.count()
    while most > bucket_rows * 256**rounds:
        rounds += 1
    state = plan.select(*levels, "whole", "more", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("string").alias("cut")).where("more > 0")
    leaf = W.partitionBy(*levels)

    def reached(state: DataFrame) -> DataFrame:
        """Rows of the bucket that each leaf's state names, with h."""
        rows = slim.join(F.broadcast(state) if few else state, levels).withColumn("h", epoch_hash(F.col("whole"), F.col("id"), seed))
        return rows.where(F.col("h").startswith(F.col("prefix")))

    kept = ["whole", "more", "prefix", "start", "cut"]
    for k in range(1, rounds + 1):
        sums = reached(state).groupBy(*levels, F.substring("h", 1, 2 * k).alias("b")).agg(F.sum("tokens").alias("s"), F.max("h").alias("last"), *(F.first(c).alias(c) for c in kept))
        upto = F.col("start") + F.sum("s").over(leaf.orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto)
        full = F.max(F.when(F.col("upto") <= F.col("more"), F.col("last"))).over(leaf)
        # the bucket in which the budget runs out is the first that it doesn't fill
        edge = sums.withColumn("full", full).where((F.col("upto") > F.col("more")) & (F.col("upto") - F.col("s") <= F.col("more")))
        state = edge.groupBy(*levels).agg(*(F.min_by(c, "b").alias(c) for c in ("whole", "more")), F.min("b").alias("prefix"), F.min_by(F.col("upto") - F.col("s"), "b").alias("start"), F.min_by(F.coalesce("full", "cut"), "b").alias("cut"))
        state = checkpointed(state)
    rows = reached(state).groupBy(*levels, "start", "more", "h").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("start") + F.sum("tokens").over(leaf.orderBy("h"))
    inside = rows.withColumn("upto", upto).where("upto <= more").groupBy(*levels).agg(F.max("h").alias("inside"))
    cut = state.select(*levels, "cut").join(inside, levels, "left").select(*levels, F.coalesce("inside", "cut").alias("cut"))
    return plan.join(cut, levels, "left")


def epoch_hash(epoch: Column, key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def mix(docs: DataFrame, path: dict[str, Column], level_weights: list[dict[str, float]], tokens: Column, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """docs, each row as often as it is taken, with the epoch (int) that takes it, its n_tokens (long) and the path's columns.

    path: names of the tree's levels, from the root, and their expressions over docs. tokens: expression of a row's tokens.
    """
    levels = [f"level_{i}" for i in range(len(path))]
    key = F.coalesce(quoted(id_col).cast("string"), F.lit("null"))
    parts = [F.coalesce(e.cast("string"), F.lit("")) for e in path.values()]
    count = F.coalesce(tokens.cast("long"), F.lit(0))
    slim = checkpointed(docs.select(key.alias("id"), *(e.alias(x) for e, x in zip(parts, levels, strict=True)), count.alias("tokens")))
    leaves = slim.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, levels, level_weights, share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("more", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = checkpointed(plan)
    few = plan.count() <= BROADCAST_LEAVES
    plan = checkpointed(cut_offs(slim, plan, levels, seed, few))
    own = docs.columns
    epoch, n_tokens, *shown = fresh(docs, "epoch", "n_tokens", *path)
    row, ids, n, *at = fresh(docs, "row_", "id_", "tokens_", *levels)
    packed = docs.select(F.struct(*(quoted(c) for c in own)).alias(row), key.alias(ids), count.alias(n), *(e.alias(x) for e, x in zip(parts, at, strict=True)))
    plan = plan.select(*(F.col(x).alias(f"p_{x}") for x in levels), F.col("whole").alias("p_whole"), F.col("cut").alias("p_cut"))
    if few:
        plan = F.broadcast(plan)
    joined = packed.join(plan, [quoted(x) == F.col(f"p_{y}") for x, y in zip(at, levels, strict=True)])
    taken = F.col("p_whole") + F.when(epoch_hash(F.col("p_whole"), quoted(ids), seed) <= F.col("p_cut"), 1).otherwise(0)
    joined = joined.withColumn("p_times", taken).where("p_times > 0").withColumn("p_epoch", F.explode(F.sequence(F.lit(0), F.col("p_times") - 1)))
    return joined.select(*(quoted(row)[c].alias(c) for c in own), F.col("p_epoch").alias(epoch), quoted(n).alias(n_tokens), *(quoted(x).alias(y) for x, y in zip(at, shown, strict=True)))


def production_path() -> dict[str, Column]:
    """Domain, language and source of documents; the domain is dealt by the source's number."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("long"), F.lit(0))
    domain = F.element_at(F.array(*(F.lit(x) for x in DOMAINS)), (number % len(DOMAINS) + 1).cast("int"))
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


PRODUCTION_WEIGHTS = [DOMAINS, LANGUAGES, {}]
