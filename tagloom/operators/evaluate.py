"""Votes, agreement with the curated labels, and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import UNKNOWN
from tagloom.functions.values import as_column, round_half_even


def tags_by_class(long: DataFrame, label: str, value: str = "value") -> DataFrame:
    """The distinct tags of every class."""
    return long.filter(as_column(value).isNotNull()).select(
        as_column(label), as_column(value)
    ).distinct()


def best_class_per_tag(
    scores: DataFrame, keys: Sequence[str], label: str, score: str
) -> DataFrame:
    """The class with the highest score of every tag, ties by label: keys, predicted, score."""
    best = F.min(F.struct((-as_column(score)).alias("s"), as_column(label).alias("l")))
    return (
        scores.groupBy(*[as_column(k) for k in keys])
        .agg(best.alias("__best"))
        .select(
            *[as_column(k) for k in keys],
            F.col("__best.l").alias("predicted"),
            (-F.col("__best.s")).alias("score"),
        )
    )


def majority_vote(
    tags: DataFrame,
    records: DataFrame | None,
    sample_id: str,
    predicted: str = "predicted",
    score: str | None = None,
    default: str = UNKNOWN,
) -> DataFrame:
    """The most frequent prediction of every record, ties by label.

    (sample_id, predicted, votes), plus the mean ``score`` of the winning label when asked for.
    With ``records``, records without any tag get the default label and no score. Votes are
    counted per record and label first, so a record with very many tags is a few rows when its
    winner is chosen.
    """
    measures = [F.count(F.lit(1)).alias("votes")]
    if score:
        measures.append(F.avg(as_column(score)).alias("score"))
    counted = (
        tags.filter(as_column(predicted).isNotNull())
        .groupBy(as_column(sample_id), as_column(predicted).alias("predicted"))
        .agg(*measures)
    )
    fields = [(-F.col("votes")).alias("v"), F.col("predicted").alias("p")]
    if score:
        fields.append(F.col("score").alias("s"))
    winner = counted.groupBy(as_column(sample_id)).agg(F.min(F.struct(*fields)).alias("w"))
    shown = [F.col("w.p").alias("predicted"), (-F.col("w.v")).alias("votes")]
    if score:
        shown.append(F.col("w.s").alias("score"))
    votes = winner.select(as_column(sample_id), *shown)
    if records is None:
        return votes
    everyone = records.select(as_column(sample_id)).distinct()
    return (
        everyone.join(votes, sample_id, "left")
        .withColumn("predicted", F.coalesce("predicted", F.lit(default)))
        .withColumn("votes", F.coalesce("votes", F.lit(0)))
    )


def compare_predictions(
    predictions: DataFrame,
    truth: DataFrame,
    sample_id: str,
    predicted: str = "predicted",
    label: str = "label",
) -> DataFrame:
    """Predictions with their curated label and whether both are the same.

    A prediction without a curated label keeps a null label and counts as not passed.
    ``truth`` has one row per id.
    """
    table = truth.select(as_column(sample_id), as_column(label).alias("__truth"))
    # The truth is often derived, so it isn't measured first; adaptive execution picks the join.
    joined = predictions.join(table, sample_id, "left")
    return joined.select(
        *[as_column(c) for c in predictions.columns],
        F.col("__truth").alias("truth"),
        F.coalesce(F.col("__truth") == as_column(predicted), F.lit(False)).alias("passed"),
    )


def pass_rate(compared: DataFrame, truth: str = "truth") -> DataFrame:
    """One row: passed, total, unmatched (no curated label) and the rounded percentage."""
    n = F.count(F.lit(1))
    passed = F.sum(F.col("passed").cast("bigint"))
    return compared.agg(
        F.coalesce(passed, F.lit(0)).alias("passed"),
        n.alias("total"),
        F.coalesce(F.sum(as_column(truth).isNull().cast("bigint")), F.lit(0)).alias("unmatched"),
        round_half_even(passed / F.nullif(n, F.lit(0)) * 100, 0).alias("percent"),
    )


def result_outcomes(df: DataFrame, outcome: str) -> DataFrame:
    """Rows per outcome."""
    return df.groupBy(as_column(outcome)).agg(F.count(F.lit(1)).alias("n"))


def outcome(compared: DataFrame, allowed: Column) -> DataFrame:
    """Adds ``pass`` for agreement, ``fail`` for an answer outside the list, else ``differs``."""
    return compared.withColumn(
        "outcome", F.when(F.col("passed"), "pass").when(~allowed, "fail").otherwise("differs")
    )


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    (class, precision, recall, f1, support). Everything follows from the counts per pair of
    labels; only those are shuffled.
    """
    pairs = df.groupBy(as_column(truth).alias("t"), as_column(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # every pair counts once for its true and once for its predicted class
    sides = F.array(
        F.struct(
            F.col("t").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("chosen"),
            F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
        ),
        F.struct(
            F.col("p").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("chosen"),
            F.lit(0).cast("bigint").alias("hit"),
        ),
    )
    totals = (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit"))
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    rates = totals.withColumn("precision", share(F.col("hit"), F.col("chosen"))).withColumn(
        "recall", share(F.col("hit"), F.col("support"))
    )
    both = F.col("precision") + F.col("recall")
    per_class = rates.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), both))

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    overall = per_class.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )

    def line(name: str, prefix: str) -> Column:
        cells = [
            F.col(f"{prefix}{c}") if prefix else F.col("accuracy")
            for c in ("precision", "recall", "f1")
        ]
        return F.struct(
            F.lit(name).alias("class"),
            *[c.alias(n) for c, n in zip(cells, ("precision", "recall", "f1"))],
            F.col("support"),
        )

    lines = F.array(
        line("accuracy", ""), line("macro avg", "macro_"), line("weighted avg", "weighted_")
    )
    shown = per_class.select("class", "precision", "recall", "f1", "support")
    return shown.unionByName(overall.select(F.inline(lines)))


def accuracy_matrix(
    grid: DataFrame,
    models: Sequence[str],
    embedding: str = "embedding",
    classifier: str = "classifier",
    accuracy: str = "accuracy",
) -> DataFrame:
    """One row per vector column, one accuracy column per classifier."""
    return (
        grid.groupBy(as_column(embedding))
        .pivot(classifier, list(models))
        .agg(F.first(as_column(accuracy)))
    )


def evaluate_tags(
    scores: DataFrame,
    records: DataFrame,
    sample_id: str,
    tag: str,
    label: str,
    score: str,
    truth: str,
) -> DataFrame:
    """From class scores per tag to one row per record: prediction, truth, passed, score.

    ``records`` has one row per record with its curated label. The score shown is the mean over
    the tags that voted for the winner.
    """
    best = best_class_per_tag(scores, [sample_id, tag], label, score)
    votes = majority_vote(best, records, sample_id, "predicted", "score")
    return compare_predictions(votes, records, sample_id, "predicted", truth)
