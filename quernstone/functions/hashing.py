"""Repeatable randomness: every random choice is a hash of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(seed: int, *keys: Column) -> Column:
    """First 32 bits of the md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def u01(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1)."""
    return u32(seed, *keys).cast("double") / F.lit(4294967296.0)


def order_key(seed: int, *keys: Column) -> Column:
    """A hash to order by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))
