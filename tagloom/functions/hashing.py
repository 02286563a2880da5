"""Stable pseudo-random numbers from ids, equal on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.values import ColumnOrName, as_column

HASH_BITS = 52


def stable_hash(seed: int, *ids: ColumnOrName) -> Column:
    """52-bit whole number from md5 of seed and ids.

    md5 rather than the engine's own hash, so that a sample can be drawn again anywhere.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[as_column(i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *ids: ColumnOrName) -> Column:
    """Number in (0, 1] per id."""
    return (stable_hash(seed, *ids) + F.lit(1)) / F.lit(float(2**HASH_BITS + 1))
