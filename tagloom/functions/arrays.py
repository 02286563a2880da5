"""Functions on number arrays: vector arithmetic and running totals inside one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.values import ColumnOrName, as_column

_ZERO = 0.0


def parse_vector(c: ColumnOrName) -> Column:
    """``"[0.1 0.2]"`` or ``"[0.1, 0.2]"`` -> array of doubles."""
    bare = F.trim(F.regexp_replace(as_column(c), r"[\[\],\s]+", " "))
    return F.when(
        bare != "", F.transform(F.split(bare, " "), lambda x: x.try_cast("double"))
    ).otherwise(F.array().cast("array<double>"))


def doubles(c: ColumnOrName) -> Column:
    return as_column(c).cast("array<double>")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(_ZERO), lambda total, x: total + x)


def norm(a: ColumnOrName) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(doubles(a), F.lit(_ZERO), lambda total, x: total + x * x))


def difference(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Euclidean distance."""
    return norm(difference(a, b))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity, 0 when a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(_ZERO))


def unit(a: ColumnOrName) -> Column:
    """Scale to length 1; a zero vector stays as it is."""
    a = doubles(a)
    # vector and length travel as one array entry, so the length is worked out once per row
    scaled = F.transform(
        F.array(F.struct(a.alias("v"), norm(a).alias("n"))),
        lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]),
    )
    return F.get(scaled, F.lit(0))


def starts_from_lengths(lengths: ColumnOrName, block: int = 64) -> Column:
    """Running total before each entry: [3, 1, 4] -> [0, 3, 4].

    Worked out in blocks, because appending to one long array copies it every time. Pass a
    column that is already computed: it is read once per block.
    """
    lengths = as_column(lengths)

    def totals(values: Column) -> Column:
        return F.aggregate(
            values,
            F.array(F.lit(0)),
            lambda seen, x: F.array_append(seen, F.element_at(seen, -1) + x),
        )

    # the running totals of each block: one more than it has entries, the last is its sum
    blocks = F.transform(
        F.filter(lengths, lambda _x, i: i % block == 0),
        lambda _x, b: totals(F.slice(lengths, b * block + 1, block)),
    )
    bases = totals(F.transform(blocks, lambda t: F.element_at(t, -1)))
    placed = F.zip_with(
        blocks,
        bases,
        lambda t, base: F.when(
            t.isNotNull(),
            F.transform(F.slice(t, 1, F.size(t) - 1), lambda x: x + base),
        ),
    )
    return F.flatten(F.filter(placed, lambda p: p.isNotNull()))


def unnest(
    df: DataFrame, values: Column, keep: Sequence[ColumnOrName], name: str, pos: str | None = None
) -> DataFrame:
    """One row per array entry that is not null, with the ``keep`` columns.

    The outer form on purpose: for a plain explode the optimiser adds a filter on the array's
    size, and pushing that filter down works out the whole array expression a second time (for
    an n-gram expression over text, once per word).
    """
    entry = (
        F.posexplode_outer(values).alias(pos, name) if pos else F.explode_outer(values).alias(name)
    )
    return df.select(*[as_column(k) for k in keep], entry).filter(F.col(name).isNotNull())


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once per row, whatever is done with it later.

    A filter on an ordinary computed column is pushed below it with the whole expression copied
    into the filter, once per mention. Nothing is pushed below a generated column, so an
    expensive value (parsed JSON) goes through a generator with one entry.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
