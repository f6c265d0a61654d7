"""Document fingerprints by Order MinHash.

Every k-mer of the text's UTF-8 bytes is numbered by its occurrence (first, second, ...), so repeats are different items.
Each of the hash functions picks its `picks` smallest items; the k-mers picked are put in the order in which they stand
in the text, and the tuple is hashed. Two texts agree in a function if it picked the same k-mers in the same order, which
gets likelier the smaller their edit distance is: moving passages around lowers it, which plain MinHash can't see.

A text is compared with its successor in descending order of doc_id without a global sort in one task: ids are cut into
ranges at approximate quantiles, each range is sorted by itself, and gets the first document of the range after it.

Defined results: a null text counts as empty; an empty text has no k-mer and the fingerprint of nothing, equal to that of
any empty text; a text shorter than k bytes is one k-mer; a null doc_id comes after all others; rows that repeat a doc_id
stand in the order of their texts; a single row is its own successor; an empty table gives an empty result; only the id
and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import partitions, quoted, text_or_empty

K, PICKS, FUNCTIONS = 12, 2, 32
#: Expected items of a function below its threshold; a function with fewer than it needs is looked at in full.
EXPECTED = 8
#: Items that are hashed by all functions at once.
CHUNK = 1 << 13


@lru_cache(maxsize=8)
def odd_factors(n: int, bits: int, seed: int) -> np.ndarray:
    raw = [int.from_bytes(hashlib.blake2b(f"{seed}|{i}".encode(), digest_size=8).digest(), "little") for i in range(n)]
    return np.array([(x | 1) & ((1 << bits) - 1) for x in raw], dtype=f"uint{bits}")


STEP, MIX_A, MIX_B, OCCURRENCE, PAIR = odd_factors(5, 64, 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX_A
    x = (x ^ (x >> np.uint64(32))) * MIX_B
    return x ^ (x >> np.uint64(31))


def kmer_hashes(data: bytes, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each place; of the whole text if it is shorter."""
    if not data:
        return np.empty(0, np.uint64)
    values = np.frombuffer(data if len(data) >= k else data + bytes(k - len(data)), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    total, done, width, factor, have = None, 0, values, STEP, 1
    while True:  # double the width; take the widths that k is the sum of
        if k & have:
            n = len(values) - k + 1
            part = width[done : done + n]
            with np.errstate(over="ignore"):
                total = part.copy() if total is None else total * factor + part
            done += have
        if have * 2 > k:
            return mixed(total)
        with np.errstate(over="ignore"):
            width = width[:-have] * factor + width[have:]
            factor = factor * factor
        have *= 2


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each value stands before its place. A slot table clears all but repeats and a few chance meetings, which are sorted."""
    n = len(x)
    bits = max(4, (4 * n).bit_length())
    slots = (x >> np.uint64(64 - bits)).astype(np.int64)
    places = np.arange(n, dtype=np.int32)
    table = np.empty(1 << bits, np.int32)
    table[slots[::-1]] = places[::-1]
    first = table[slots]
    odd = np.flatnonzero(first != places)
    seen = np.zeros(n, np.uint64)
    if len(odd):
        value = x[odd]
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        starts = np.r_[True, ranked[1:] != ranked[:-1]]
        rank = np.arange(len(odd)) - np.maximum.accumulate(np.where(starts, np.arange(len(odd)), 0))
        seen[odd[order]] = rank + (x[first[odd[order]]] == ranked)
    return seen


def signature(data: bytes, k: int = K, picks: int = PICKS, functions: int = FUNCTIONS) -> np.ndarray:
    """uint16 for each function: the hash of the tuple of k-mers that it picks, in text order."""
    x = kmer_hashes(data, k)
    if not len(x):
        return np.zeros(functions, np.uint16)
    with np.errstate(over="ignore"):
        item = (mixed(x + occurrences(x) * OCCURRENCE) >> np.uint64(32)).astype(np.uint32)
        factors = odd_factors(functions, 32, 2)[:, None]
        n = len(item)
        limit = np.uint32(min((1 << 32) - 1, (EXPECTED + picks) * (1 << 32) // n))
        rows, places, values = [], [], []
        for at in range(0, n, CHUNK):
            hashed = item[None, at : at + CHUNK] * factors
            hits = np.flatnonzero((hashed <= limit).ravel())
            r, c = np.divmod(hits, hashed.shape[1])
            rows.append(r)
            places.append(c + at)
            values.append(hashed.ravel()[hits])
        row, place, value = np.concatenate(rows), np.concatenate(places), np.concatenate(values)
        short = np.flatnonzero(np.bincount(row, minlength=functions) < min(picks, n))
        for f in short:
            order = np.argsort(item * factors[f, 0], kind="stable")[:picks]
            keep = row != f
            row, place, value = np.r_[row[keep], np.full(len(order), f)], np.r_[place[keep], order], np.r_[value[keep], (item * factors[f, 0])[order]]
        order = np.argsort(row.astype(np.uint64) << np.uint64(32) | value, kind="stable")
        row, place = row[order], place[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, place = row[rank < picks], place[rank < picks]
        order = np.lexsort((place, row))
        row, picked = row[order], x[place[order]]
        out = np.zeros(functions, np.uint64)
        each = np.searchsorted(row, np.arange(functions + 1))
        for i in range(picks):
            there = each[:-1] + i < each[1:]
            out[there] = mixed(out[there] * PAIR + picked[each[:-1][there] + i] + np.uint64(i + 1))
    return (out >> np.uint64(48)).astype(np.uint16)


def written(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, picks: int = PICKS, functions: int = FUNCTIONS) -> DataFrame:
    """(doc_id, fingerprint): four hexadecimal digits for each function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [written(signature(t.as_buffer().to_pybytes(), k, picks, functions)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """Share of the functions in which two fingerprints agree."""
    pieces = F.zip_with(F.regexp_extract_all(a, F.lit("(.{4})")), F.regexp_extract_all(b, F.lit("(.{4})")), lambda x, y: (x == y).cast("int"))
    return F.aggregate(pieces, F.lit(0), lambda s, x: s + x) / F.size(pieces)


def ranges(docs: DataFrame, key: str, n: int) -> tuple[Column, int]:
    """Number of the range of the key, counted from the largest key down, and how many ranges there are; the cuts are n - 1 numbers."""
    cuts = sorted({int(x) for x in docs.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)}, reverse=True)
    if not cuts:
        return F.lit(0), 1
    step = isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    nested = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    id_ = F.col(key)
    outer = F.size(F.filter(nested, lambda g: F.get(g, F.lit(0)) > id_))
    inner = F.size(F.filter(F.get(nested, outer - 1), lambda c: c > id_))
    return F.when(outer == 0, 0).otherwise((outer - 1) * step + inner).cast("int"), len(cuts) + 1


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, picks: int = PICKS, functions: int = FUNCTIONS) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how like they are to each other and to the next document's.

    The edited text has its last third (code points, rounded down) replaced by as much of the start of the next document.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    range_, n = ranges(rows.select("key"), "key", 2 * partitions(spark))
    rows = rows.withColumn("range", range_)
    firsts = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.max("key").alias("first")).collect())  # a row for each range
    if not firsts:
        return spark.createDataFrame([], DDL)
    after = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    follow = spark.range(1).select(F.inline(F.from_json(F.lit(str([{"edge": a, "key": b} for a, b in after]).replace("'", '"')), "array<struct<edge:int,key:bigint>>")))
    edges = rows.select("key", "text").join(F.broadcast(follow), "key").groupBy("edge", "key").agg(F.min("text").alias("text"))
    rows = rows.select("range", F.lit(0).alias("edge"), "key", "doc_id", "text").union(edges.select("edge", F.lit(1), "key", F.lit(None).cast("long"), "text"))
    dealt = rows.repartition(n, "range").sortWithinPartitions("range", "edge", F.desc("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held = None
        for b in batches:
            out = []
            for edge, doc_id, text in zip(b.column(1), b.column(3), b.column(4), strict=True):
                text, edge = text.as_py(), edge.as_py()
                own = signature(text.encode(), k, picks, functions)
                if held is not None:
                    before_id, before, sig = held
                    cut = len(before) // 3
                    edited = (before[: len(before) - cut] + text[:cut]).encode()
                    changed = signature(edited, k, picks, functions)
                    out.append((before_id, len(before), hashlib.sha256(edited).hexdigest(), written(sig), written(changed), float((sig == changed).mean()), float((sig == own).mean())))
                held = None if edge else (doc_id.as_py(), text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return dealt.mapInArrow(run, DDL)


DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
