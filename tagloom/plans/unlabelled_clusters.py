"""Records -> text of their values -> vectors -> as many clusters as there are labels, to compare the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.operators import cluster as cl
from tagloom.operators import labels as lb
from tagloom.operators import text as tx
from tagloom.operators import vectors as vc
from tagloom.operators import wordvectors as wv

#: Seed of the clusters here: a fixed value.
SEED = 1


def record_vectors(
    records: DataFrame,
    fields: Sequence[str],
    sample_id: str = "sample_id",
    vectors: DataFrame | None = None,
    dimension: int = 300,
    min_count: int = 5,
) -> DataFrame:
    """Adds ``text``, the values of the set fields, and ``vector``, the mean of its words' vectors, scaled to length 1.

    Records without any value go. Without a table of word ``vectors`` they are learned from the texts of all records. Ids
    must be unique.
    """
    shown = tx.drop_empty_text(records.withColumn("text", fn.render_values(list(fields))))
    if vectors is None:
        vectors = wv.train_word_vectors(shown, "text", dimension, min_count=min_count)
    pooled = vc.document_embedding(shown, sample_id, "text", vectors, dimension, stop_words=())
    unit = vc.l2_normalize(pooled, "vector").withColumnRenamed("sample_id", "__id")
    return shown.join(unit, shown[sample_id] == unit["__id"]).drop("__id")


def cluster_records(
    described: DataFrame, label: str, vector: str = "vector", k: int | None = None, seed: int = SEED
) -> DataFrame:
    """Adds ``cluster`` and ``pca``, two coordinates. ``k`` is the number of labels that occur, unless it is given."""
    k = k or max(2, lb.class_values(described, label).count())
    placed = cl.kmeans(described, vector, k, seed)
    return cl.pca_2d(placed, vector)


def distribution(placed: DataFrame, label: str) -> DataFrame:
    """(cluster, label, n, share): what the clusters hold, and which part of each."""
    counted = cl.cluster_composition(placed, "cluster", label)
    sizes = cl.cluster_sizes(placed).withColumnRenamed("n", "size")  # one row per cluster
    return counted.join(F.broadcast(sizes), "cluster").withColumn("share", F.col("n") / F.col("size")).drop("size")
