"""N-gram Jaccard join: texts whose sets of word shingles are alike, exactly.

A text's set is sorted 64-bit hashes of its different shingles; equal sets are one node from the start. Where two sets of n and m shingles
are at the similarity t or above, they have a shingle in common among the first n - ceil(t n) + 1 of the one and as many by m of
the other, in any order that all sets share. Here the order is by hash, with shingles last that many prefixes turned out to
hold (counted over all texts): so a passage that stands in many documents makes no keys. Whatever is put last, the result is the same.

Nodes with a shingle of their prefixes in common meet in tiles, with their sizes, the shingle's places and a bitmap of 512 bits: bit b is the
parity of the number of shingles hashed to b. Where bitmaps differ in x bits, the sets differ in x shingles at least, so
(n + m - x) / 2 bounds their overlap from above; so do the places, n - i and m - j, at their first common shingle. Only pairs that these bounds allow leave a
tile, and their sets' overlap is counted in the sorted arrays. A shingle of up to COLD nodes shares its tile with others. A shingle of more is cut by size band first,
a band being as wide as the similarity allows sizes to differ, so that only a band and the next one meet; each band is cut into blocks, and
each pair of blocks is a tile of its own.

The result needs what is connected, not all pairs. So pairs are sought in rounds: first the likeliest partner of each node in its tile, and in
a crowded shingle the node that holds most crowded shingles; then the likeliest EIGHT; then all that are left. Nodes that are connected already are no pair
any more, and a shingle whose nodes are all connected makes no tile, nor one of which no pair was left in the round before; in a crowded one the nodes of
its largest component don't meet each other. The last round has no limit, so no link is lost.

Defined results: a text without words (null, empty, blank) has an empty set, links with nothing and is its own component; a null id takes
part in no link and has a null component; rows that repeat an id get a row each, and link like any others; an empty table gives an
empty result; only the id and text columns are read, so other columns can't clash. Hashes stand for shingles, and 128-bit digests for sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import quoted
from quernstone.llm.line_dedup import bitmap as bitmap_of
from quernstone.llm.line_dedup import perhaps_in
from quernstone.llm.order_minhash import mixed, odd_factors
from quernstone.operators.graph import connected_components
from quernstone.sources.storage import Scratch

WIDTH, PERCENT = 5, 80
#: Bits of a bitmap; nodes of a shingle that shares its tile; nodes of a block; rows of a shared tile.
BITS, COLD, BLOCK, TILE_ROWS = 512, 64, 4096, 20_000
#: Passes that count prefixes; bound on the shingles that are put last, which all tasks get as a list.
DEMOTIONS, MOST = 1, 250_000
#: Partners of a node in a tile, by round; None: all.
ROUNDS = (1, 8, None)
PAIRS = "a long, b long, token long"
#: Ids of at most so many nodes are broadcast to find their texts; more are joined by key.
BROADCAST_IDS = 1_000_000


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles. bytes.lower and bytes.split know ASCII letters and blanks only."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, 42) for x in data.lower().split()], dtype=np.uint64)
    if not len(w):
        return w
    taken = min(width, len(w))
    total = np.full(len(w) - taken + 1, taken, np.uint64)
    with np.errstate(over="ignore"):
        for factor, i in zip(odd_factors(width, 64, 13), range(taken), strict=False):
            total += factor * w[i : i + len(total)]
        total = np.sort(mixed(total))
    return total[np.r_[True, total[1:] != total[:-1]]]


def bitmap(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BITS) & 1 == 1, bitorder="little").view(np.int64)


class Last:
    """The shingles that are put last in the order, and their places there."""

    def __init__(self, order: np.ndarray):
        by = np.argsort(order, kind="stable")
        self.order, self.tokens, self.rank = order, order[by], by

    def before(self, more: np.ndarray) -> Last:
        """With more shingles in front of these."""
        return Last(np.concatenate([more, self.order]))

    def prefix(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first k of a sorted set in the order."""
        if not len(self.tokens):
            return s[:k]
        for some in (s[: 2 * k + 16], s):  # most sets have few of them
            at = np.minimum(np.searchsorted(self.tokens, some), len(self.tokens) - 1)
            late = self.tokens[at] == some
            first = some[~late]
            if len(first) >= k:
                return first[:k]
        return np.concatenate([first, s[late][np.argsort(self.rank[at[late]], kind="stable")]])[:k]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def data_of(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column)


def digest_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def marked(texts: DataFrame, width: int, percent: int, last: Last) -> DataFrame:
    """(doc_id, digest, n, prefix, bits) of each row of (doc_id, text). The list of what comes last goes to each executor once."""
    shared = texts.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            digests, sizes, prefixes, bits = [], [], [], []
            for data in data_of(b.column(1)):
                s = shingle_set(data, width)
                digests.append(digest_of(s))
                sizes.append(len(s))
                prefixes.append(order.prefix(s, prefix_size(len(s), percent)).view(np.int64) if len(s) else np.empty(0, np.int64))
                bits.append(bitmap(s))
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), np.concatenate([*x, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), flat(prefixes), flat(bits)], ["doc_id", "digest", "n", "prefix", "bits"])

    return texts.mapInArrow(run, "doc_id long, digest binary, n long, prefix array<long>, bits array<long>")


def put_last(texts: DataFrame, width: int, percent: int, passes: int = DEMOTIONS, most: int = MOST) -> Last:
    """What stands in more prefixes than COLD, in each pass the `most` commonest. The order only says where pairs meet, not which are found."""
    last = Last(np.empty(0, np.uint64))
    for _ in range(passes):
        counts = marked(texts, width, percent, last).select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
        found = counts.where(F.col("c") > COLD).orderBy(F.desc("c"), "token").limit(most).toArrow()
        tokens, c = found.column("token").to_numpy().view(np.uint64), found.column("c").to_numpy()
        new = ~np.isin(tokens, last.tokens)
        if not new.any():
            break
        tokens, c = tokens[new], c[new]
        last = last.before(tokens[np.lexsort((tokens, c))])
    return last


def likeliest(a: np.ndarray, b: np.ndarray, bound: np.ndarray, most: int | None) -> np.ndarray:
    """Which of the pairs are among the `most` with the largest bound of their first or of their second member."""
    if most is None or not len(a):
        return np.ones(len(a), bool)
    keep = np.zeros(len(a), bool)
    for side in (a, b):
        order = np.lexsort((-bound, side))
        x = side[order]
        starts = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1]
        place = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
        keep[order[place < most]] = True
    return keep


class Members:
    """The rows of a tile as arrays."""

    def __init__(self, table: pa.Table):
        get = lambda c: table.column(c).to_numpy()
        self.token, self.node, self.n, self.at, self.component = (get(c) for c in ("token", "node", "n", "at", "component"))
        self.bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        self.table = table

    def allowed(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of rows (i, j) those that may be at the similarity and aren't connected, with the bound of their similarity."""
        n, m = self.n[i], self.n[j]
        total = n + m
        ok = (self.component[i] != self.component[j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        ok &= np.minimum(n - self.at[i], m - self.at[j]) * (100 + percent) >= percent * total
        i, j, total = i[ok], j[ok], total[ok]
        apart = np.zeros(len(i), np.int64)
        for k in range(self.bits.shape[1]):
            apart += np.bitwise_count(self.bits[i, k] ^ self.bits[j, k])
        ok = (total - apart) * (100 + percent) >= 2 * percent * total
        i, j, total, apart = i[ok], j[ok], total[ok], apart[ok]
        return i, j, (total - apart) / (total + apart)

    def pairs(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray, most: int | None) -> pa.Table:
        """(a, b, token): the likeliest pairs of nodes, each once, and without nodes the shingles of which pairs were left for later."""
        a, b = np.minimum(self.node[i], self.node[j]), np.maximum(self.node[i], self.node[j])
        keep = likeliest(a, b, bound, most)
        met = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0)
        later = np.unique(self.token[i[~keep]])
        both = lambda c: pa.concat_arrays([pa.array(met[:, c]), pa.nulls(len(later), pa.int64())])
        return pa.table({"a": both(0), "b": both(1), "token": pa.concat_arrays([pa.nulls(len(met), pa.int64()), pa.array(later)])})


def shared_tile(percent: int, most: int | None):
    """Pairs in a tile of many shingles: rows of one shingle stand side by side, and each meets the next, the one after it and so on."""

    def run(table: pa.Table) -> pa.Table:
        x = Members(table.sort_by([("token", "ascending"), ("node", "ascending")]))
        met, d = [], 1
        while d < len(x.token) and len(i := np.flatnonzero(x.token[d:] == x.token[:-d])):
            met.append(x.allowed(i, i + d, percent))
            d += 1
        i, j, bound = (np.concatenate([m[k] for m in met] or [np.empty(0, np.int64)]) for k in range(3))
        return x.pairs(i, j, bound, most)

    return run


def block_tile(percent: int, most: int | None):
    """Pairs in a tile of two blocks of one shingle and size band, or of one block with itself. `home` rows are of the band, others of the next one."""

    def run(table: pa.Table) -> pa.Table:
        x = Members(table)
        home, side = table.column("home").to_numpy(zero_copy_only=False), table.column("side").to_numpy()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        met = []
        for start in range(0, len(first), 64):
            part = first[start : start + 64]
            if len(second):
                i, j = np.repeat(part, len(second)), np.tile(second, len(part))
            else:
                i, j = np.repeat(part, len(first)), np.tile(first, len(part))
                i, j = i[i < j], j[i < j]
            inside = home[i] | home[j]
            met.append(x.allowed(i[inside], j[inside], percent))
        i, j, bound = (np.concatenate([m[k] for m in met] or [np.empty(0, np.int64)]) for k in range(3))
        return x.pairs(i, j, bound, most)

    return run


def shared_pairs(rows: DataFrame, n: int, percent: int, most: int | None) -> DataFrame:
    """Pairs of shingles with few nodes. n: rows that there are."""
    open_ = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    tile = F.pmod(F.xxhash64("token"), F.lit(max(1, n // TILE_ROWS)))
    return rows.join(open_, "token", "left_semi").withColumn("tile", tile).groupBy("tile").applyInArrow(shared_tile(percent, most), PAIRS)


def block_pairs(rows: DataFrame, percent: int, most: int | None, block: int = BLOCK) -> DataFrame:
    """Pairs of shingles with many nodes, by size band and pair of blocks; the largest component of a band doesn't meet itself."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = rows.withColumn("b", band).withColumn("band", F.explode(F.array("b", F.col("b") - 1))).withColumn("home", F.col("b") == F.col("band"))
    sizes = rows.groupBy("token", "band", "component").agg(F.count("*").alias("k"), F.max("home").alias("home"))
    sizes = sizes.groupBy("token", "band").agg(F.sum("k").alias("k"), F.max(F.struct("k", "component")).alias("most"), F.max("home").alias("home")).where("home")
    blocks = lambda x: F.ceil(x / block).cast("int")
    sizes = sizes.select("token", "band", F.col("most.component").alias("largest"), blocks(F.col("k") - F.col("most.k")).alias("small"), blocks(F.col("most.k")).alias("large")).where("small > 0")
    at = lambda x: F.pmod(F.xxhash64("node"), x).cast("int")
    rows = rows.join(sizes, ["token", "band"]).withColumn("own", F.when(F.col("component") == F.col("largest"), F.col("small") + at(F.col("large"))).otherwise(at(F.col("small"))))
    inner = F.col("own") < F.col("small")
    before = F.transform(F.sequence(F.lit(0), F.least("own", F.col("small") - 1)), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    after = F.when(inner & (F.col("own") + 1 < F.col("small") + F.col("large")), F.transform(F.sequence(F.col("own") + 1, F.col("small") + F.col("large") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))))
    tiles = F.concat(before, F.coalesce(after, F.array().cast("array<struct<i int, j int>>")))
    rows = rows.withColumn("t", F.explode(tiles)).withColumn("side", F.when(F.col("own") == F.col("t.i"), 0).otherwise(1))
    rows = rows.select("token", "band", "t.i", "t.j", "node", "n", "at", "component", "bits", "home", "side")
    return rows.groupBy("token", "band", "i", "j").applyInArrow(block_tile(percent, most), PAIRS)


def leader_pairs(rows: DataFrame) -> DataFrame:
    """Each node of a crowded shingle with the one among them that stands in most rows of such shingles."""
    weight = rows.groupBy("node").agg(F.sum("c").alias("weight"))
    leaders = rows.join(weight, "node").groupBy("token").agg(F.max(F.struct("weight", "node")).alias("first")).select("token", F.col("first.node").alias("leader"))
    return rows.join(leaders, "token").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.lit(None).cast("long").alias("token"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sorted sets have enough in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(bool(np.count_nonzero(large[at] == small) * (100 + percent) >= percent * (len(x) + len(y))))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(texts: DataFrame, nodes: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, s): the sorted set of each of nodes (node, id, digest), from the text of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(data, width) for data in data_of(b.column("text"))]
            keep = pa.array([digest_of(s) == d.as_py() for s, d in zip(sets, b.column("digest"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node").filter(keep), pa.array([s.tobytes() for s in sets], pa.binary()).filter(keep)], ["node", "s"])

    n = nodes.count()
    own = nodes.select(F.col("id").alias("doc_id"), "node", "digest")
    sets = scratch.store(texts.join(F.broadcast(own) if n <= BROADCAST_IDS else own, "doc_id").select("text", "node", "digest").mapInArrow(run, "node long, s binary"))
    return sets if sets.count() == n else scratch.store(sets.dropDuplicates(["node"]))  # rows that repeat an id and its text


def node_components(texts: DataFrame, nodes: DataFrame, width: int, percent: int, scratch: Scratch, cold: int = COLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(node, component) for the nodes that are linked with others, and all nodes (node, id, digest, bits). nodes: (node, id, digest, n, prefix, bits), the table stored last, which goes."""
    prefixes = scratch.n - 1
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    counts = scratch.store(entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    rows = scratch.store(perhaps_in(entries, F.col("token"), bitmap_of(counts.select("token"), counts.count())).join(counts, "token"))
    nodes = scratch.store(nodes.select("node", "id", "digest", "bits"))
    scratch.drop(prefixes)
    bits = nodes.select("node", "bits")
    few, many = rows.where(F.col("c") <= cold), rows.where(F.col("c") > cold)
    crowded = not many.isEmpty()
    known = tried = None
    for most in ROUNDS:
        now = lambda x: x.withColumn("component", F.col("node")) if known is None else x.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = shared_pairs(now(few).join(bits, "node"), few.count(), percent, most)
        if crowded:
            found = found.union(leader_pairs(many) if known is None else block_pairs(now(many).join(bits, "node"), percent, most, block))
        found = scratch.store(found.distinct())
        pairs = found.where("a is not null").select("a", "b")
        pairs = scratch.store(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        inside = scratch.store(nodes.select("node", "id", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
        start = scratch.n
        sets = sets_of(texts, inside, width, scratch)
        links = scratch.store(verified(pairs, sets, percent))
        scratch.drop(*range(start, scratch.n - 1))
        # Only shingles of which pairs were left have more to give; of the crowded ones, in the first round, all.
        left = found.where("a is null").select("token")
        few = scratch.store(few.join(left, "token", "left_semi"))
        if known is not None and crowded:
            many = scratch.store(many.join(left, "token", "left_semi"))
        if known is None:
            known = scratch.store(connected_components(links).select(F.col("id").alias("node"), "component"))
        elif not links.isEmpty():
            known = merged(known, links, scratch)
    return known, nodes


def merged(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) with more links (a, b); components are named by nodes."""
    x, y = (known.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    across = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    joined = scratch.store(connected_components(across).select(F.col("id").alias("component"), F.col("component").alias("whole")))
    both = known.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.join(known.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    return scratch.store(both.union(alone))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, cold: int = COLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = texts_of(docs, id_col, text_col)
    marks = scratch.store(marked(texts, width, percent, put_last(texts, width, percent)))
    groups = marks.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    slim = scratch.store(marks.select("doc_id", "digest", "n"))
    nodes = scratch.store(groups.withColumn("node", F.monotonically_increasing_id()))
    scratch.drop(0)  # the prefixes of all rows
    known, nodes = node_components(texts, nodes, width, percent, scratch, cold, block)
    named = nodes.select("node", "digest", "id").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = scratch.store(named.join(least, "component").select("digest", "component_id"))
    # A digest can have a third of all rows; the adaptive plan splits such a partition.
    joined = slim.join(named.hint("merge"), "digest", "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
