"""Row order over a whole table without bringing the table into one task."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.hashing import HASH_BITS, stable_hash
from tagloom.functions.values import as_column

#: Rows that are sorted to name the last one; more are narrowed down by a sketch first.
SORTED_ROWS = 10_000
#: Size of the sketch, and twice the part of the rows that its ranks may be off by.
SKETCH, RANK_ERROR = 2_048, 0.004
BUCKET_BITS = 16

_KEY = "__key"
_BUCKET = "__bucket"
_ORDER = "__order"
_LOWEST = -(2**63)


class _Last(NamedTuple):
    """The order of the last of the first rows, how many rows of just that order are among them, and whether all are."""

    order: Column
    needed: int
    all: bool


def first_rows(df: DataFrame, key: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest key, ties by the given columns, then by a hash of the row.

    Exactly ``n`` rows, or all if there are no more. Nulls come first, in the key and in the ties, as
    in an ascending sort. Keys may have any type with an order. The last row is found by a sketch and
    counting, so rows are filtered where they are and none of them is shuffled for being among the first.
    """
    if n <= 0:
        return df.limit(0)
    placed = df.withColumn(_ORDER, _order(df, key, ties))
    last = _last(placed, n)
    if last is None:
        return df
    if last.all:
        return placed.filter(F.col(_ORDER) <= last.order).drop(_ORDER)
    before = placed.filter(F.col(_ORDER) < last.order).drop(_ORDER)
    # Rows that agree in the key, the ties and the hash: any of them will do.
    return before.union(placed.filter(F.col(_ORDER) == last.order).drop(_ORDER).limit(last.needed))


def first_rows_flag(df: DataFrame, key: Column, n: int, flag: str, *ties: str) -> DataFrame:
    """All rows, with a boolean column, never null, that is true for the ``n`` of :func:`first_rows`.

    The place where the first ``n`` end is found in passes of their own, so the split itself needs no
    shuffle, unless equal rows stand on both sides of it: those are numbered.
    """
    if n <= 0:
        return df.withColumn(flag, F.lit(False))
    placed = df.withColumn(_ORDER, _order(df, key, ties))
    last = _last(placed, n)
    if last is None:
        return df.withColumn(flag, F.lit(True))
    names = [as_column(c) for c in ([*df.columns, flag] if flag not in df.columns else df.columns)]
    if last.all:
        return placed.withColumn(flag, F.col(_ORDER) <= last.order).select(*names)
    number = F.row_number().over(Window.partitionBy(_ORDER).orderBy(_ORDER))
    same = placed.filter(F.col(_ORDER) == last.order).withColumn(flag, number <= last.needed)
    others = placed.filter(F.col(_ORDER) != last.order).withColumn(flag, F.col(_ORDER) < last.order)
    return others.select(*names).union(same.select(*names))


def _order(df: DataFrame, key: Column, ties: tuple[str, ...]) -> Column:
    """Key, ties and a hash of the row as one value; values compare with nulls first."""
    kinds = dict(df.dtypes)
    whole = [F.map_entries(as_column(c)) if kinds[c].startswith("map<") else as_column(c) for c in df.columns]
    return F.struct(key.alias("k"), *[as_column(t).alias(f"t{i}") for i, t in enumerate(ties)], F.xxhash64(*whole).alias("h"))


def _whole_number(key: Column, kind: T.DataType, lead: int) -> Column:
    """A whole number that never falls as the key grows. Keys with equal numbers are told apart later.

    Of texts it is the seven bytes behind the first ``lead`` ones. Types without such a number all get 0.
    """
    if isinstance(kind, T.IntegralType):
        number = key.cast("bigint")
    elif isinstance(kind, T.FractionalType):
        # the bits of a double are in its order but for the negative ones, which run backwards; NaN is above all
        double = key.cast("double")
        size = F.floor(F.log2(F.least(F.greatest(F.abs(double), F.lit(1e-300)), F.lit(1e308))) * F.lit(float(1 << 50)))
        number = F.when(F.isnan(double), F.lit(2**62)).when(double > 0, size + (1 << 61)).when(double < 0, -size - (1 << 61)).otherwise(0)
    elif isinstance(kind, T.DateType):
        number = F.unix_date(key).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(key)
    elif isinstance(kind, T.StringType):
        seven = F.hex(F.substring(key.cast("binary"), lead + 1, 7))
        number = F.conv(F.rpad(seven, 14, "0"), 16, 10).cast("bigint")
    else:
        number = F.lit(0).cast("bigint")
    return F.when(key.isNull(), F.lit(_LOWEST)).otherwise(number)


def _last(placed: DataFrame, n: int) -> _Last | None:
    """Where the first ``n`` rows (at least one) end, None if there are no more than that.

    One pass counts the rows and sketches their keys as whole numbers. The sketch gives two numbers with the n-th row
    almost surely between them; a second pass counts what lies below and between, and only what lies between is
    sorted. If the row is not between after all, the borders are moved apart. The driver sees sketches and counts only.
    """
    inside = placed.select(_ORDER)
    kind = placed.schema[_ORDER].dataType
    key, key_kind = F.col(_ORDER)["k"], kind["k"].dataType
    size = inside.count()
    if size <= n:
        return None
    left = n
    if size > SORTED_ROWS:
        lead = 0
        if isinstance(key_kind, T.StringType):
            ends = inside.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
            lead = _common(ends["low"], ends["high"])
        number = _whole_number(key, key_kind, lead)
        sketch = inside.agg(F.kll_sketch_agg_bigint(number, F.lit(SKETCH)).alias("s"))
        error = RANK_ERROR
        while True:
            ranks = [max(0.0, n / size - error), min(1.0, n / size + error)]
            low, high = sketch.select(*[F.kll_sketch_get_quantile_bigint("s", F.lit(r)).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
            # at either end there is no border
            above = F.lit(True) if ranks[0] == 0.0 else number >= low
            below = F.lit(True) if ranks[1] == 1.0 else number <= high
            counts = inside.agg(F.count_if(~above).alias("under"), F.count_if(above & below).alias("between")).first()
            if counts["under"] < n <= counts["under"] + counts["between"]:
                break
            error *= 8
        inside, left = inside.filter(above & below), n - counts["under"]
    # the row behind the last tells whether equal ones follow
    groups = inside.orderBy(_ORDER).limit(left + 1).groupBy(_ORDER).agg(F.count(F.lit(1)).alias("n"))
    end = groups.orderBy(F.desc(_ORDER)).limit(2).collect()
    if end[0]["n"] == 1 and len(end) == 2:
        return _Last(_literal(end[1][_ORDER], kind), end[1]["n"], True)
    if len(end) == 1 and end[0]["n"] <= left:
        return _Last(_literal(end[0][_ORDER], kind), end[0]["n"], True)
    return _Last(_literal(end[0][_ORDER], kind), end[0]["n"] - 1, False)


def _common(low: str | None, high: str | None) -> int:
    """Bytes that two texts, and so all between them, begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _literal(row, kind) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields, strict=True)])


def numbered(ids: DataFrame, id_column: str, number: str, seed: int = 0) -> DataFrame:
    """Number distinct ids 0, 1, 2, ... in the order of their hash.

    Hashes are even, so leading bits cut the ids into equal buckets; each is sorted on its own
    and starts where the buckets before it end (there are at most ``2 ** BUCKET_BITS``).
    """
    keyed = (
        ids.select(id_column)
        .distinct()
        .withColumn(_KEY, stable_hash(seed, id_column))
        .withColumn(_BUCKET, F.shiftright(F.col(_KEY), HASH_BITS - BUCKET_BITS).cast("int"))
    )
    sizes = keyed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        _BUCKET, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(_BUCKET).orderBy(_KEY, id_column)
    return (
        keyed.join(F.broadcast(offsets), _BUCKET, "left")  # at most 65,536 rows of two numbers
        .withColumn(number, F.col("__offset") + F.row_number().over(inside) - 1)
        .select(id_column, number)
    )
