"""Labelled records -> tags per class -> tag scores -> vote per record -> report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import attributes as at
from tagloom.operators import classify as cf
from tagloom.operators import evaluate as ev
from tagloom.operators import labels as lb
from tagloom.operators.joins import lookup_join
from tagloom.operators.tfidf import TfidfModel, fit_tfidf


@dataclass(frozen=True)
class Tagger:
    model: TfidfModel
    centroids: DataFrame
    fields: tuple[str, ...]
    sample_id: str
    label: str

    def tags(self, records: DataFrame) -> DataFrame:
        """One row per record and tag: (sample_id, pos, value)."""
        return at.to_long(records, self.sample_id, self.fields).select("sample_id", "pos", "value")

    def evaluate(self, records: DataFrame) -> DataFrame:
        """One row per record: predicted, votes, score, truth, passed."""
        tags = self.tags(records)
        # equal tags get equal scores, so each is scored once
        distinct = tags.select("value").distinct()
        vectors = self.model.arrays(distinct, "value", "v")
        best = cf.best_classes(vectors, "v", self.centroids, self.label).select("value", "best")
        voted = lookup_join(tags, best, ["value"], keep=True).select(
            "sample_id",
            F.col("best.label").alias("predicted"),
            F.col("best.score").alias("score"),
        )
        truth = records.select(
            F.col(self.sample_id).alias("sample_id"), F.col(self.label).alias("label")
        )
        votes = ev.majority_vote(voted, truth, "sample_id", "predicted", "score")
        return ev.compare_predictions(votes, truth, "sample_id")


def train(
    records: DataFrame,
    fields: Sequence[str],
    sample_id: str,
    label: str,
    stop_words: Iterable[str] = (),
    max_features: int = 300,
    min_df: int = 1,
) -> Tagger:
    """Learn from the distinct tags of every class. ``records`` has one row per record."""
    labelled = records.filter(F.col(label).isNotNull())
    cells = F.array(*[F.col(f).cast("string") for f in fields])
    long = labelled.select(F.col(label), F.explode_outer(cells).alias("value"))
    examples = ev.tags_by_class(long, label)
    model = fit_tfidf(examples, "value", stop_words, max_features, min_df=min_df, max_df=1.0)
    vectors = model.arrays(examples, "value", "v")
    return Tagger(model, cf.class_centroids(vectors, label, "v"), tuple(fields), sample_id, label)


def split(records: DataFrame, n: int, order: str) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` records for training, the rest for testing."""
    marked = lb.split_first_n(records, n, order)
    return (
        marked.filter("is_training").drop("is_training"),
        marked.filter("NOT is_training").drop("is_training"),
    )
