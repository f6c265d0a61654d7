"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits: bit b is 1 if it is set in over half of the hashes of the text's word shingles. Two fingerprints
that differ in at most `distance` bits agree on some blocks - distance of them short - when they are cut into `blocks`
pieces; so each distinct fingerprint is listed under every choice of blocks - distance blocks, equal keys are joined and
the Hamming distance is verified. Copies of one fingerprint are one row of that join. A key that more than `hot`
fingerprints share is not joined with itself: its fingerprints are listed under themselves and their 64 neighbours at one
bit (distance 4: two bits) instead. Two fingerprints within the distance have such a neighbour in common and no others do, so
a star around each neighbour's smallest member connects what the join would have connected, in rows that grow with the
group and not with its square.

Components: alternating star contraction, each round stored in the shared folder, until nothing changes.

The pipeline's stage takes the pairs that SimHash links, by the same fingerprints and blocks, and keeps those whose sets of five-word
shingles have the Jaccard similarity in full. No radius with usable blocks covers all such pairs, so more candidates come from MinHash bands: a pair at the similarity of 0.8 shares none of the 32 bands of 4 with
probability (1 - 0.8 ** 4) ** 32 = 5e-8. Every candidate's sets are compared, so each link is at the similarity or above it. Equal
sets are one node. In a band key of more than `hot` nodes all meet the node that shares most keys first. Nodes of such a key that are not
connected then are joined by prefix filter, which is exact: of two sets of sizes n and m at the similarity or above, the n - ceil(0.8 n) + 1
first shingles of the one and as many by m of the other have one in common, in whatever order all sets are put. The order is by hash, with
shingles last that many of these sets have, so what a large group has in common is hardly a key, and a pair meets only in places after
which both sets have enough shingles left for the similarity. Only prefixes become rows. Nothing is left out for the size of its group.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows each get a row; a
null doc_id takes part in no link but gets its fingerprint and a null component; an empty table gives an empty result;
only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, quoted
from quernstone.llm.order_minhash import PAIR, mixed, odd_factors
from quernstone.operators.graph import connected_components

DISTANCE, BLOCKS, HOT = 2, 5, 24
#: Words of a shingle of the fingerprints by which the pipeline's stage links first.
WIDTH = 3
#: Of the pipeline's stage: shingles of five words, Jaccard similarity in percent, MinHash bands and functions of a band.
STAGE_WIDTH, STAGE_PERCENT, BANDS = 5, 80, (32, 4)
#: Bound on the common shingles that are broadcast, and shingles that a task counts at once.
MOST_COMMON, COUNTED = 10_000, 1 << 22


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """The hashes of the word shingles in order. bytes.lower and bytes.split know ASCII letters and blanks only."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], dtype=np.uint64)


def fingerprint_of(data: bytes, width: int) -> int:
    """The fingerprint, as a signed integer of 64 bits."""
    hashes = shingle_hashes(data, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the id and the fingerprint, as a long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, distance: int, blocks: int) -> list[Column]:
    """For each choice of blocks - distance blocks: which choice, and the fingerprint's bits there."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - distance)]
    return [F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(chosen)]


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect what fingerprints at most distance bits apart connect. nodes: (fp, id), fp unique.

    distance is 2 or 4: neighbours at one or two bits then lie between any two fingerprints that are to be linked.
    """
    if distance not in (2, 4) or blocks <= distance:
        raise ValueError("distance must be 2 or 4, and blocks more than that")
    listed = nodes.select("fp", "id", F.explode(F.array(*block_keys(F.col("fp"), distance, blocks))).alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = checkpointed(listed.join(sizes, "key"))
    cold = listed.where(F.col("n") <= hot)
    a, b = cold.select("key", F.col("fp").alias("fa"), F.col("id").alias("a")), cold.select("key", F.col("fp").alias("fb"), F.col("id").alias("b"))
    met = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance)).select("a", "b")
    crowd = listed.where(F.col("n") > hot).select("fp", "id").distinct()
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    flips = [0, *bits] + ([x ^ y for x, y in combinations(bits, 2)] if distance == 4 else [])
    near = crowd.select("id", F.explode(F.transform(F.from_json(F.lit(str(flips)), "array<bigint>"), lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
    least = near.groupBy("middle").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("middle", "a")
    star = near.join(least, "middle").where("a < id").select("a", F.col("id").alias("b"))
    return met.union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = DISTANCE, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the smallest doc_id that links lead to, its own included."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, width))
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = checkpointed(nodes)
    found = connected_components(links(nodes, distance, blocks, hot))
    names = nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    # A fingerprint can have a third of all rows; the adaptive plan splits such a partition of marked.
    joined = marked.join(names.hint("merge"), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def band_keys(shingles: np.ndarray, bands: int, functions: int) -> np.ndarray:
    """For each band the hash of its number and of the least values of its functions over a set of shingle hashes."""
    item = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    factors = odd_factors(bands * functions, 32, 3)[:, None]
    least = np.full(bands * functions, (1 << 32) - 1, np.uint32)
    step = (1 << 18) // (bands * functions)
    with np.errstate(over="ignore"):
        for i in range(0, len(item), step):
            np.minimum(least, (item[None, i : i + step] * factors).min(axis=1), out=least)
        keys = np.arange(1, bands + 1, dtype=np.uint64)
        for column in least.reshape(bands, functions).T:
            keys = mixed(keys * PAIR + column + np.uint64(1))
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp, n, keys, mark): hash and size of each row's set of shingles, its band keys, and its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([band_keys(x, *BANDS) for x in sets], pa.list_(pa.int64()))
            marks = pa.array([fingerprint_of(t, WIDTH) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array([len(x) for x in sets], pa.int64()), keys, marks], ["doc_id", "fp", "n", "keys", "mark"])

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, n long, keys array<long>, mark long")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(fp, shingles): the set of shingle hashes of each row of docs (text), with its hash as in sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", width)) for t in b.column(0)]
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp long, shingles array<long>")


def frequent_shingles(sets: DataFrame, above: int) -> DataFrame:
    """(key, df): shingles that more than that many of sets (shingles) have. Each task adds up its own sets first and leaves out what it saw once, so
    a count may be short by one for each task, or for each COUNTED shingles of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1])], ["key", "n"])

        parts, size = [np.empty(0, np.int64)], 0
        for b in batches:
            parts.append(b.column(0).flatten().to_numpy())
            size += len(parts[-1])
            if size > COUNTED:
                yield counted()
                parts, size = [np.empty(0, np.int64)], 0
        yield counted()

    return sets.select("shingles").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("df")).where(F.col("df") > above)


def prefix_keys(sets: DataFrame, percent: int, most: int = MOST_COMMON) -> DataFrame:
    """(fp, key, at): the shingles in the prefix of each of sets (fp, shingles), and their places. The order is by hash, with frequent shingles last, rarest first.

    Only prefixes become rows, about a fifth of a set. Shingles that more sets have than the most-th part of all entries are fewer than `most`, whatever the
    data; their list is broadcast and met with each set as a whole. Which shingles are on it changes how many pairs meet, not which are found.
    """
    sets = checkpointed(sets)
    bound = max(64, (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) // most)
    found = frequent_shingles(sets, bound)
    common = checkpointed(found.agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "key"))), lambda x: x["key"]).alias("common")))
    n, known = F.size("shingles"), sets.crossJoin(F.broadcast(common))  # one row of fewer than `most` numbers
    k = F.concat(F.array_except("shingles", "common"), F.array_intersect("common", "shingles"))
    taken = (n - F.ceil(n * percent / 100) + 1).cast("int")
    return checkpointed(known.select("fp", F.posexplode(F.slice(k, F.lit(1), taken)).alias("at", "key")).select("fp", "key", "at"))


def simhash_pairs(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of nodes (fp, mark) whose SimHash fingerprints (mark) are at most distance bits apart; of those with one fingerprint, all with the least."""
    marks = checkpointed(nodes.groupBy(F.col("mark").alias("fp")).agg(F.min("fp").alias("id")))
    same = nodes.join(marks.select(F.col("fp").alias("mark"), F.col("id").alias("a")).hint("merge"), "mark").where("a < fp").select("a", F.col("fp").alias("b"))
    return links(marks, distance, blocks, hot).union(same).distinct()


def jaccard_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, hot: int) -> DataFrame:
    """(a, b): links that connect what pairs of sets at the similarity or above connect. docs: (doc_id, text); nodes: (fp, id, n, keys, mark), fp unique."""
    near = checkpointed(simhash_pairs(nodes, hot=hot))
    listed = nodes.select("fp", "n", F.explode("keys").alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    listed = checkpointed(listed.join(sizes, "key"))
    some = listed.select("fp").union(near.select("a")).union(near.select("b")).distinct()
    inner = nodes.join(some, "fp", "left_semi").select("id").distinct()
    texts = docs.join(inner.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = checkpointed(shingle_sets(texts, width).dropDuplicates(["fp"]))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        alike = both * (100 + percent) >= percent * (F.size("sa") + F.size("sb"))
        return checkpointed(pairs.distinct().join(a, "a").join(b, "b").where(alike).select("a", "b"))

    def sized(other: DataFrame, mine: DataFrame, on: Column) -> DataFrame:
        """Pairs of members of a key whose sizes allow the similarity."""
        allowed = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return other.join(mine, (F.col("ka") == F.col("kb")) & on & allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def side(rows: DataFrame, s: str, *more: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"k{s}"), F.col("fp").alias(s), F.col("n").alias(f"n{s}"), *(F.col(c).alias(c + s) for c in more))

    cold, crowd = listed.where(F.col("size") <= hot), listed.where(F.col("size") > hot)
    found = verified(sized(side(cold, "a"), side(cold, "b"), F.col("a") < F.col("b")).union(near))
    if crowd.isEmpty():
        return found
    weight = crowd.groupBy("fp").agg(F.sum("size").alias("weight"))
    leaders = crowd.join(weight, "fp").groupBy("key").agg(F.max(F.struct("weight", "fp", "n")).alias("first")).select("key", "first.fp", "first.n")
    found = checkpointed(found.union(verified(sized(side(crowd, "a"), side(leaders, "b"), F.col("a") != F.col("b")))).distinct())
    # Members of one component need no further links; the others of a key all meet.
    known = connected_components(found).withColumnRenamed("id", "fp")
    known = checkpointed(crowd.join(known, "fp", "left").withColumn("c", F.coalesce("component", "fp")))
    open_ = known.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("key")
    rest = checkpointed(known.join(open_, "key", "left_semi").select("fp", "n", "c").distinct())
    if rest.isEmpty():
        return found
    fine = prefix_keys(sets.join(rest, "fp", "left_semi"), percent).join(rest, "fp")
    shared = fine.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("key")
    fine = checkpointed(fine.join(shared, "key", "left_semi"))
    enough = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return found.union(verified(sized(side(fine, "a", "c", "at"), side(fine, "b", "c", "at"), (F.col("ca") < F.col("cb")) & enough))).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = STAGE_WIDTH, percent: int = STAGE_PERCENT, hot: int = HOT) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; of rows that repeat such an id, all stay. Rows without an id stay."""
    known = docs.where(quoted(id_col).isNotNull())
    marked = sketches(known, id_col, text_col, width)
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("mark").alias("mark")))
    texts = known.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    found = connected_components(jaccard_links(texts, nodes, width, percent, hot)).withColumnRenamed("id", "fp")
    kept = nodes.join(found, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("id").alias(KEPT)).select(KEPT).distinct()
    return docs.join(kept, quoted(id_col).cast("long") == F.col(KEPT), "left_semi").unionByName(docs.where(quoted(id_col).isNull()))


KEPT = "kept doc_id of near_duplicates"
