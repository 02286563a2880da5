"""Labels and attributes -> balanced sample -> text -> features -> clusters and classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.constants import ENGLISH_STOP_WORDS, NULL_MARKERS, SAMPLE_SEED
from tagloom.operators import attributes as at
from tagloom.operators import cluster as cl
from tagloom.operators import labels as lb
from tagloom.operators import text as tx
from tagloom.operators.tfidf import fit_tfidf


def labelled_sample(
    labels: DataFrame,
    attributes: DataFrame,
    n: int | None,
    fields: Sequence[str],
    weight_field: str = "source_type",
    how: str = "equal",
    seed: int = SAMPLE_SEED,
    markers: Iterable[str] = NULL_MARKERS,
    position: str | None = None,
) -> DataFrame:
    """``n`` labels (None: all) joined to their attributes, null markers removed.

    ``labels`` has sample_id, source_type and source_niche; of repeated ids the last by ``position`` counts,
    and without that column there must be none. ``how`` is ``equal`` (every class
    alike), ``proportional`` or ``random``.
    """
    last = lb.last_wins(labels, "sample_id", position) if position else labels
    usable = lb.labelled_only(last)
    if n is None:
        chosen = usable
    elif how == "random":
        chosen = lb.uniform_sample(usable, n, "sample_id", seed)
    else:
        weighted = lb.class_weight(usable, weight_field, equal=how == "equal")
        chosen = lb.weighted_sample(weighted, n, "weight", "sample_id", seed).drop("weight")
    return at.null_markers(lb.label_records(attributes, chosen, keep=True), fields, markers)


def tfidf_features(
    sample: DataFrame,
    fields: Sequence[str] = ("isolation_source",),
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
    max_features: int = 300,
) -> DataFrame:
    """Adds the cleaned text and its TF-IDF vector as an array."""
    with_text = tx.assemble_text(sample, fields, name="text")
    model = fit_tfidf(with_text, "text", stop_words, max_features)
    return model.arrays(with_text, "text", "tfidf")


def cluster_report(
    features: DataFrame, methods: Sequence[str], label: str = "source_type", k: int = 5
) -> DataFrame:
    """Rows per method, cluster and label: (method, cluster, label, n)."""
    placed = cl.cluster_all_methods(features, methods, k)
    by_method = placed.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("method"), F.col(f"{m}_cluster").alias("cluster"))
                    for m in methods
                ]
            )
        ).alias("m"),
        F.col(label).alias("label"),
    )
    counted = by_method.groupBy("m.method", "m.cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("method", "cluster", F.desc("n"), "label")
