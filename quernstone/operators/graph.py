"""The row-token graph and what is computed on graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.hashing import order_key, u01
from quernstone.functions.text import MAX_TOKENS, tokenize
from quernstone.operators.cells import capped
from quernstone.sources.storage import Scratch, stored


def token_frequency(tokens: DataFrame) -> DataFrame:
    """(tok, df, n_edges): rows and cells that have the token."""
    return tokens.groupBy("tok").agg(F.count_distinct("id").alias("df"), F.count("*").alias("n_edges"))


def token_lists(cells: DataFrame, most: int | None = MAX_TOKENS) -> DataFrame:
    """(id, lists): for each row the different tokens of each of its cells, of the first `most` or of all (None). Texts move, not tokens."""
    rows = cells.groupBy("id").agg(F.collect_list(F.struct("col", "val")).alias("cells"))
    return rows.select("id", F.transform("cells", lambda c: F.struct(c["col"].alias("col"), F.array_distinct(tokenize(c["val"], most)).alias("toks"))).alias("lists"))


def row_frequency(lists: DataFrame) -> DataFrame:
    """(tok, df) of lists as from token_lists: rows that have the token. Counts are added before they move."""
    return lists.select(F.explode(F.array_distinct(F.flatten("lists.toks"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


def kept_tokens(frequency: DataFrame, n_rows: Column, max_df: float, least: int) -> DataFrame:
    """frequency with stop (in more than int(max_df * rows) rows) and rare (fewer than least, and not stop)."""
    stop = F.col("df") > F.floor(F.lit(max_df) * n_rows)
    return frequency.withColumn("stop", stop).withColumn("rare", ~stop & (F.col("df") < least))


#: So many kept tokens, counted, are broadcast; more are joined by key.
MOST_TOKENS = 1_000_000


def only_kept(tokens: DataFrame, kept: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Rows of tokens whose tok is in kept (tok), which is stored. Up to `most` of them are sent to every task, so that the tokens stay where they are."""
    return tokens.join(F.broadcast(kept) if kept.count() <= most else kept.hint("merge"), "tok", "left_semi")


def build_edges(cells: DataFrame, n_rows: int, max_df: float = 0.3, least: int = 1, cap: int = 16, seed: int = 42) -> DataFrame:
    """(id, col, tok): edges after the frequency filter, the degree filter and the cap of a cell. Cells are tokenised once, whole."""
    lists = stored(token_lists(cells, None))
    kept = stored(kept_tokens(row_frequency(lists), F.lit(n_rows), max_df, least).where("not stop and not rare").select("tok"))
    tokens = lists.select("id", F.inline("lists")).select("id", "col", F.explode("toks").alias("tok"))
    return capped(only_kept(tokens, kept), cap, seed).select("id", "col", "tok")


#: So many links, counted, are joined in the memory of one task (16 bytes each) in place of rounds over tables.
FEW_LINKS = 20_000


def joined_in_memory(links: DataFrame) -> DataFrame:
    """(id, component) of a few links (u, v), u > v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        ids = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "component"])

    return links.coalesce(1).mapInArrow(run, "id long, component long")


def connected_components(edges: DataFrame, most_rounds: int = 100, few: int = 0) -> DataFrame:
    """(id, component): for each id of edges (a, b) the smallest id that it is connected with.

    Large star: every node hands its larger neighbours to its smallest one. Small star: its smaller ones. Both keep what is
    connected and shrink the depth; the stars that are left when nothing changes are the components. Only minima are
    gathered, never a node's list. Each round is stored in the shared folder, so plans and size estimates don't grow with
    the rounds and a lost executor costs one round at most. Where `few` links at most are there, they need no rounds; ids are
    whole numbers then.
    """
    scratch = Scratch(edges.sparkSession, "components")
    alone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    stars = scratch.store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    if few and stars.limit(few + 1).count() <= few:
        linked = joined_in_memory(stars)
        return scratch.store(linked.union(alone.join(linked, "id", "left_anti").distinct()))
    before = None
    for _ in range(most_rounds):
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        stars = scratch.store(small.select("u", "m").union(small.where("v > m").select("v", "m")).distinct().toDF("u", "v"))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.keep_last()
        if now == before:
            linked = stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
            return linked.union(alone.join(linked, "id", "left_anti").distinct())
        before = now
    raise RuntimeError("the components did not settle")


def greedy_split(sizes: list[tuple[int, int]], ratios: tuple[float, ...], total: int) -> dict[int, int]:
    """Component -> split: components, largest first, each to the split that lacks most of its share of the total."""
    have, out = [0.0] * len(ratios), {}
    for component, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        lacks = [r * total - h for r, h in zip(ratios, have, strict=True)]
        out[component] = lacks.index(max(lacks))
        have[out[component]] += n
    return out


#: Components that are placed one by one, largest first; smaller ones are so many that shares by hash are even.
PLACED = 10_000


def component_split(pairs: DataFrame, components: DataFrame, ratios: tuple[float, ...], seed: int, placed: int = PLACED) -> DataFrame:
    """pairs (a, b, ...) with split: a number below len(ratios), the same for a whole component. components (id, component).

    The `placed` largest components go, largest first, to the split that lacks most; they are what the driver sees. Each of the
    others goes by a hash of its id to a split with the chances that are still lacking then.
    """
    rows = stored(pairs.join(components.withColumnRenamed("id", "a"), "a"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    largest = [(r["component"], r["n"]) for r in sizes.orderBy(F.desc("n"), "component").limit(placed).collect()]
    total = rows.count()
    own = greedy_split(largest, ratios, total)
    have = [sum(n for c, n in largest if own[c] == k) for k in range(len(ratios))]
    lacks = [max(r * total - h, 0.0) for r, h in zip(ratios, have, strict=True)]
    share = [sum(lacks[: k + 1]) / (sum(lacks) or 1.0) for k in range(len(ratios) - 1)]
    by_hash = sum((F.when(u01(seed, F.col("component")) >= x, 1).otherwise(0) for x in share), F.lit(0))
    table = pairs.sparkSession.createDataFrame(list(own.items()) or [(0, 0)], "component long, `placed split` int")
    return rows.join(F.broadcast(table), "component", "left").withColumn("split", F.coalesce("placed split", by_hash)).drop("component", "placed split")  # `placed` rows at most


def neighbour_sample(edges: DataFrame, seeds: DataFrame, hops: int, fan_out: int, seed: int) -> DataFrame:
    """(hop, src, dst): around the seeds (id), at most fan_out neighbours of each node by hash, hop by hop. edges (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    front, out = seeds.select(F.col("id").alias("a")).distinct(), None
    for hop in range(1, hops + 1):
        ranked = both.join(front, "a").withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(order_key(seed, F.lit(hop), F.col("a"), F.col("b")), "b")))
        taken = ranked.where(F.col("r") <= fan_out).select(F.lit(hop).alias("hop"), F.col("a").alias("src"), F.col("b").alias("dst"))
        out = taken if out is None else out.union(taken)
        front = taken.select(F.col("dst").alias("a")).distinct()
    return out
