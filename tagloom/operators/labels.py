"""Labels: choosing labelled records, joining them, weights, samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.constants import (
    BATCH_SIZE,
    RECORD_ID_PREFIX,
    SAMPLE_SEED,
    SPLIT_SEED,
    SPLIT_TEST_SIZE,
)
from tagloom.functions.hashing import stable_hash, uniform
from tagloom.functions.values import as_column
from tagloom.operators.joins import lookup_join
from tagloom.operators.order import first_rows, first_rows_flag, numbered
from tagloom.session import stored


def labelled_only(
    df: DataFrame, sample_id: str = "sample_id", label: str = "source_type"
) -> DataFrame:
    return df.filter(as_column(sample_id).isNotNull() & as_column(label).isNotNull())


def valid_ids(
    df: DataFrame, sample_id: str = "sample_id", prefix: str = RECORD_ID_PREFIX
) -> DataFrame:
    return df.filter(as_column(sample_id).startswith(prefix))


def last_wins(df: DataFrame, sample_id: str, pos: str) -> DataFrame:
    """One row per id, the one with the highest position.

    An aggregate instead of a window: every task first reduces its own rows of an id to one.
    """
    rest = [c for c in df.columns if c != sample_id]
    best = F.max_by(F.struct(*[as_column(c) for c in rest]), as_column(pos)).alias("__row")
    return (
        df.groupBy(as_column(sample_id))
        .agg(best)
        .select(as_column(sample_id), *[F.col("__row").getField(c).alias(c) for c in rest])
    )


def label_records(
    records: DataFrame, labels: DataFrame, sample_id: str = "sample_id", keep: bool = False
) -> DataFrame:
    """Records that have a label, with the label columns. ``labels`` has one row per id.

    ``keep`` stores the labels, for a sample that would otherwise be drawn twice.
    """
    return lookup_join(records, labels, [sample_id], keep=keep)


def restrict_to_ids(
    df: DataFrame, ids: DataFrame, sample_id: str = "sample_id", keep: bool = False
) -> DataFrame:
    """Rows whose id is on the list."""
    listed = ids.select(as_column(sample_id))
    if keep:
        listed = stored(listed, "ids")
    return lookup_join(df, listed.distinct(), [sample_id], "left_semi", measured=listed)


def missing_records(
    wanted: DataFrame, stored: DataFrame, sample_id: str = "sample_id"
) -> DataFrame:
    """Rows whose id is not stored yet."""
    known = stored.select(as_column(sample_id))
    present = known.filter(as_column(sample_id).isNotNull()).distinct()
    return lookup_join(wanted, present, [sample_id], "left_anti", measured=known)


def pending_prompts(
    prompts: DataFrame, answers: DataFrame, sample_id: str = "sample_id", force: bool = False
) -> DataFrame:
    """Prompts without a stored answer, or all of them."""
    return prompts if force else missing_records(prompts, answers, sample_id)


def class_values(df: DataFrame, label: str = "source_type") -> DataFrame:
    """The classes that occur."""
    return df.filter(as_column(label).isNotNull()).select(as_column(label)).distinct()


def class_list(df: DataFrame, label: str = "source_type", max_classes: int = 10_000) -> list[str]:
    """The classes as a sorted Python list, for a prompt or a report heading."""
    found = class_values(df, label).orderBy(as_column(label)).limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"column {label!r} has more than {max_classes} values: not a class column")
    return [row[0] for row in found]


def class_weight(
    df: DataFrame, label: str, name: str = "weight", equal: bool = True
) -> DataFrame:
    """Adds ``1 / rows of the class`` (every class equally likely), or the rows of the class.

    Counted first and joined back. A window over the class would bring all rows of a large class
    into one task.
    """
    counts = df.groupBy(as_column(label)).agg(F.count(F.lit(1)).alias("__n"))
    weight = F.lit(1.0) / F.col("__n") if equal else F.col("__n").cast("double")
    return (
        lookup_join(df, counts, [label], "left", keep=True)
        .withColumn(name, weight)
        .select(*[as_column(c) for c in df.columns], as_column(name))
    )


def sampling_key(weight: Column, seed: int, *ids: str) -> Column:
    """Key whose smallest values are a weighted sample without replacement (Efraimidis-Spirakis)."""
    return -F.log(uniform(seed, *ids)) / weight


def weighted_sample(
    df: DataFrame, n: int, weight: str, sample_id: str, seed: int = SAMPLE_SEED
) -> DataFrame:
    """``n`` rows without replacement, more likely with higher weight. Ids must be unique."""
    usable = df.filter(as_column(weight) > 0)
    return first_rows(usable, sampling_key(as_column(weight), seed, sample_id), n, sample_id)


def uniform_sample(
    df: DataFrame, n: int, sample_id: str, seed: int = SAMPLE_SEED
) -> DataFrame:
    """``n`` rows, all equally likely. Ids must be unique."""
    return first_rows(df, stable_hash(seed, sample_id), n, sample_id)


def head(df: DataFrame, n: int, order: str, *ties: str) -> DataFrame:
    """The first ``n`` rows by a column, nulls first; ties by the given columns, then by a hash of the row."""
    return first_rows(df, as_column(order), n, *ties)


def split_first_n(
    df: DataFrame, n: int, order: str, name: str = "is_training", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Marks exactly the first ``n`` rows by a column, ordered as in :func:`head`; the rest is for testing."""
    return first_rows_flag(df, as_column(order), n, name, *ties)


def batch_ids(
    ids: DataFrame, sample_id: str = "sample_id", size: int = BATCH_SIZE, name: str = "batch"
) -> DataFrame:
    """Distinct ids in batches of exactly ``size`` (the last may be smaller)."""
    return numbered(ids, sample_id, "__n").select(
        as_column(sample_id), F.floor(F.col("__n") / F.lit(size)).cast("bigint").alias(name)
    )


def train_test_split(
    df: DataFrame,
    sample_id: str,
    test_size: float = SPLIT_TEST_SIZE,
    seed: int = SPLIT_SEED,
    name: str = "is_test",
    exact: bool = False,
) -> DataFrame:
    """Marks test rows by a hash of the id, so a row never changes sides.

    ``exact`` takes precisely ``ceil(test_size * rows)`` of them, which needs a count first.
    """
    if exact:
        n = math.ceil(test_size * df.count())
        return first_rows_flag(df, stable_hash(seed, sample_id), n, name, sample_id)
    return df.withColumn(name, uniform(seed, sample_id) <= F.lit(test_size))


def encode_labels(df: DataFrame, label: str, name: str = "label_no") -> DataFrame:
    """Classes in sorted order as 0, 1, 2, ...; a null label gives null."""
    # Only the distinct classes are sorted and numbered.
    number = F.row_number().over(Window.orderBy(as_column(label))) - 1
    classes = class_values(df, label).withColumn(name, number.cast("int"))
    return df.join(classes, label, "left").select(*[as_column(c) for c in df.columns], as_column(name))
