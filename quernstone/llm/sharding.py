"""Sharding by a permutation-filled lookup table, in DataFrame expressions only.

Every shard has its own preference order over the slots of a table of prime size: offset, offset + skip, offset + 2 skip
and so on, modulo the size. The shards take turns, and each claims the first slot of its order that is still free. A key
is placed by hashing it to a slot: one look-up in a broadcast table of fixed size, whatever the number of rows. Shards
get equal shares to within one slot, and when a shard leaves, few keys of the others move.

Defined results: a null key has one slot of its own, as if it were the text 'null'; equal keys go to the same shard, so
repeated rows stay together; an empty table gives an empty result; added columns get underscores where they clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import fresh, quoted

#: A prime: the bound on what is broadcast.
SLOTS = 4099
SHARDS = 16


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it. slots must be prime and no fewer than the shards."""
    if len(shards) > slots or slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime, no less than the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have different names, one at least")
    order = [(digest(f"offset|{s}") % slots, digest(f"skip|{s}") % (slots - 1) + 1) for s in shards]
    tried, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for k, (offset, skip) in enumerate(order):
            while table[slot := (offset + tried[k] * skip) % slots] >= 0:
                tried[k] += 1
            table[slot] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("long")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): slots rows; one array literal, exploded on the JVM."""
    table = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def assign_shards(docs: DataFrame, key_col: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with slot (long) and shard (int: the position in shards)."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    slot, shard, key = fresh(docs, "slot", "shard", "slot_key")
    table = table_frame(docs.sparkSession, names, slots).select(F.col("slot").alias(key), F.col("shard").alias(shard))
    placed = docs.withColumn(slot, slot_of(quoted(key_col), slots))
    return placed.join(F.broadcast(table), quoted(slot) == quoted(key)).select(*(quoted(c) for c in docs.columns), quoted(slot), quoted(shard))


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", shards: int | list[str] = SHARDS, files_per_shard: int = 1) -> None:
    """Writes docs below path, one folder for each shard; rows are dealt to files by a salt, so no task holds a whole shard."""
    placed = assign_shards(docs, key_col, shards)
    slot, shard = placed.columns[-2:]
    n = (shards if isinstance(shards, int) else len(shards)) * files_per_shard
    placed.repartition(n, quoted(shard), quoted(slot) % files_per_shard).drop(slot).write.partitionBy(shard).mode("overwrite").parquet(path)
