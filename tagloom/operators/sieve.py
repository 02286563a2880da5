"""A sieve of fixed size for words: it lets every listed word pass, and few others."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 18


def sieve(words: DataFrame) -> Callable[[Column], Column]:
    """A test whether a word may be one of ``words`` (one text column): a bit for each hash of a word.

    The bits have one size for every list. The longer the list, the more other words pass, so what
    follows must not depend on them.
    """

    def bit(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(BITS))

    at = words.select(bit(F.col(words.columns[0])).alias("b")).distinct()
    one = F.expr("shiftleft(1L, cast(b & 63 AS INT))")
    rows = at.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(one).alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    for row in rows.collect():  # at most BITS / 64 numbers
        table[row["i"]] = row["bits"]
    # One literal text, which the optimiser turns into a constant array.
    bits = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")

    def passes(word: Column) -> Column:
        found = F.get(bits, F.shiftright(bit(word), 6).cast("int"))
        return found.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit(word) % 64).cast("int"))) != 0

    return passes
