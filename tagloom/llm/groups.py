"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import stored

#: Edges that a task holds at once when it makes stars of its own.
BLOCK_EDGES = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the same nodes that reach the same: of each node to the smallest that it reaches."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        left, right = label[x], label[y]
        apart = left != right
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while (label[label] != label).any():
            label = label[label]
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([np.asarray(batch.column(k)) for batch in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*ends)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_EDGES:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def _local_stars(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges by stars, a block at a time: fewer edges and shorter ways, the same components."""
    return edges.mapInArrow(_starred, "a long, b long")


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """The larger end of each edge goes to the least neighbour of the smaller end, or to that itself."""
    # Stored, as Spark splits the large partitions of a join only if both sides come straight from a shuffle.
    least = stored(edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), name)
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _ends(edges: DataFrame, *ends: tuple[str, str | None]) -> DataFrame:
    kinds = [F.struct(F.col(a).alias("node"), (F.col(b) if b else F.lit(None).cast("long")).alias("to")) for a, b in ends]
    return edges.select(F.explode(F.array(*kinds)).alias("e")).select("e.node", "e.to")


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a larger than b) are stars: no node leads to two others, or to one and is led to."""
    to = _ends(edges, ("a", "b"), ("b", None)).groupBy("node").agg(
        F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("center")
    )
    return not to.agg(F.max((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & F.col("center")))).first()[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """For each node with an edge, the smallest node that it reaches: columns node, component_id.

    ``edges`` has two long columns; order, repeats, loops and rows with a null don't matter. Tasks make stars
    of the edges they hold, then the two star operations alternate until all edges are stars: each leads edges
    closer to the smallest node, and no step needs a node's edges in one place. Nodes only in loops are not
    returned. An empty frame of edges gives an empty frame.
    """
    a, b = edges.columns
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = stored(_local_stars(stored(edges, name)), name)
    while not _settled(edges):
        # No step has more edges than the one before. What is read back comes in fewer, larger parts than the joins leave.
        edges = stored(_local_stars(stored(_small_star(_large_star(edges, name)), name)), name)
    return _ends(edges, ("a", "b"), ("b", "b")).distinct().withColumnRenamed("to", "component_id")
