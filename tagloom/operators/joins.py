"""Joins that hold when one key has a third of all rows.

A side is broadcast only after its size has been looked at. Otherwise rows are shuffled on the
key, and keys that are frequent on the left side are spread over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import stored

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.001
TASK_SHARE = 0.0001
SPREAD_ROWS = 1_000_000

_SALT = "__salt"


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most that many rows and bytes.

    Rows are counted first, which for stored tables reads no column; bytes only when the rows
    are few. Both are distributed sums.
    """
    if df.count() > max_rows:
        return False
    size = F.octet_length(F.to_json(F.struct(*[F.col(_quoted(c)) for c in df.columns])))
    return (df.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    measured: DataFrame | None = None,
    keep: bool = False,
) -> DataFrame:
    """Join rows to a table that is usually small, whatever size it turns out to have.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. ``measured`` is a table no
    smaller than ``right`` and cheaper to measure, e.g. the one whose distinct rows ``right`` has.
    ``keep`` stores ``right`` when it is measured, for a right side that is the result of an
    aggregate over a large table.
    """
    on = list(on)
    if keep:
        right = stored(right, "lookup")
    if fits(right if measured is None else measured, max_rows, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return spread_join(left, right, on, how)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_share: float = HOT_SHARE,
    task_share: float = TASK_SHARE,
    min_rows: int = SPREAD_ROWS,
) -> DataFrame:
    """Shuffle join that spreads the left rows of frequent keys over many tasks.

    A key with at least ``hot_share`` of the left rows is cut into parts of about ``task_share``
    of them, and its right rows are repeated once per part; together that is at most about
    ``2 / task_share`` repetitions. The part of a left row follows from a hash of the row, so a
    task that runs again sends it to the same place. The frequent keys take two passes over the
    key columns of ``left``; a side of fewer than ``min_rows`` rows is joined as it is.
    """
    on = list(on)
    rest = [c for c in left.columns if c not in on]
    if left.count() < min_rows:
        return left.join(right, on, how)
    if not rest:
        # nothing tells equal rows apart, so they cannot be spread; adaptive execution splits them
        return left.join(right, on, how)
    parts_of = _parts_per_key(left, on, hot_share, task_share)
    if not parts_of:
        return left.join(right, on, how)
    key = F.xxhash64(*[F.col(_quoted(c)) for c in on])
    parts = F.lit(1)
    for n, keys in parts_of.items():
        parts = F.when(key.isin(*keys), F.lit(n)).otherwise(parts)
    row_hash = F.xxhash64(*[_hashable(left, c) for c in rest])
    salted_left = left.withColumn(_SALT, F.pmod(row_hash, parts).cast("int"))
    salted_right = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)


def _parts_per_key(
    df: DataFrame, on: list[str], hot_share: float, task_share: float
) -> dict[int, list[int]]:
    """Number of parts -> hashes of the keys to be cut into that many (powers of two)."""
    keys = df.select(F.xxhash64(*[F.col(_quoted(c)) for c in on]).alias("k"))
    # a bounded sketch names every key with that share, and perhaps some others
    named = list(keys.stat.freqItems(["k"], hot_share).first()[0] or [])
    if not named:
        return {}
    known = F.col("k").isin(*named)
    counts = keys.groupBy(F.when(known, F.col("k")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # one per named key and one for the others
    total = sum(r["n"] for r in rows)
    parts: dict[int, list[int]] = {}
    for r in rows:
        if r["k"] is not None and r["n"] >= hot_share * total and r["n"] > 1:
            wanted = r["n"] / (task_share * total)
            parts.setdefault(2 ** max(1, math.ceil(math.log2(max(wanted, 2)))), []).append(r["k"])
    return parts


def _hashable(df: DataFrame, name: str):
    column = F.col(_quoted(name))
    # xxhash64 takes no maps
    return F.map_entries(column) if dict(df.dtypes)[name].startswith("map<") else column


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
