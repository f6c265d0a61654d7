"""Groups of documents that fit a task, and sorted hash arrays packed as bytes; for the operators that work on whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import quoted

GROUP = "grp int, doc_id long, data binary"


def grouped_documents(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(grp, doc_id, data): whole texts as UTF-8, dealt to n groups by a hash of the id.

    Every use of the frame in one plan has the same exchange below it, which Spark then runs once.
    """
    ids = quoted(id_col).cast("long")
    data = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.pmod(F.xxhash64(ids, F.lit("group")), F.lit(n)).cast("int").alias("grp"), ids.alias("doc_id"), data.alias("data"))


def rows_of(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """(doc_id, data) in an order that is the same each time: by id, then by text; a null id comes last."""
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("data").to_pylist(), strict=True))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return rows


def pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 3)


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=dtype)


def pack_sorted(values: np.ndarray, spare: int = 0) -> bytes:
    """A sorted uint64 array, whose lowest `spare` bits are zero, as differences, with bytes of one weight together: the high ones are mostly zero."""
    steps = np.diff(values >> np.uint64(spare), prepend=np.uint64(0))
    return pack(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(data: bytes, spare: int = 0) -> np.ndarray:
    raw = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(spare)


def shard_edges(values: np.ndarray, shards: int) -> np.ndarray:
    """Places that cut a sorted uint64 array into the shards of equal ranges of the hash, shards + 1 of them."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(values, bounds), len(values)]


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def every_shard(values: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Every shard with its part of a sorted array, empty ones too."""
    edges = shard_edges(values, shards)
    for s in range(shards):
        yield s, slice(int(edges[s]), int(edges[s + 1]))


def by_shard(values: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards that have a part of a sorted array, with it."""
    return ((s, at) for s, at in every_shard(values, shards) if at.stop > at.start)
