"""Approximate nearest neighbours: an index of cells, searched in the few cells next to each query.

The centres of the cells are fitted on a bounded sample; every vector goes to its nearest centre. A query is compared
with the vectors of its ``probes`` nearest cells only. Cells are put on shelves, and vectors and queries are both dealt by
shelf: a query goes once to a shelf, with the list of its cells there, and comes back with its best of all of them. A shelf that holds many
vectors or queries is cut into pieces of bounded size, so nothing that grows with the tables reaches the driver, and no
piece is more than a task can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import arrays as fn
from tagloom.functions.hashing import uniform
from tagloom.functions.values import as_column
from tagloom.operators.vectors import as_ml_vector, nearest_neighbours
from tagloom.session import stored

#: Rows that centres are fitted on, and most cells; up to there a table has as many as the root of its rows.
SAMPLE_ROWS, MOST_CELLS = 65_536, 8_192
#: Vectors and queries of a piece of a shelf, and queries that are compared with a cell in one step.
PIECE_VECTORS, PIECE_QUERIES, STEP_QUERIES = 65_536, 65_536, 1_024
#: Queries whose exact neighbours decide how many cells are searched.
TUNE_QUERIES = 256


class CellIndex(NamedTuple):
    """Centres of unit length, and all vectors as (vector_id, vector, cell), scaled to length 1."""

    centres: np.ndarray
    vectors: DataFrame


def build_index(
    df: DataFrame, vector_id: str, vector: str, cells: int | None = None, seed: int = 0, max_iter: int = 20
) -> CellIndex:
    """Cells for all vectors that are not null. The result is stored, so it can be searched again and again.

    Without ``cells`` there are as many as the square root of the rows, at most ``MOST_CELLS``. Zero vectors
    stay zero. Only the centres come from a sample (``SAMPLE_ROWS`` rows drawn by a hash of the id).
    """
    ready = df.select(as_column(vector_id).alias("vector_id"), fn.unit(vector).alias("vector")).filter(
        F.col("vector").isNotNull()
    )
    rows = ready.count()
    wanted = max(1, min(cells or math.isqrt(rows), MOST_CELLS, rows))
    if wanted > 1:
        sample = ready
        if rows > SAMPLE_ROWS:
            sample = ready.filter(uniform(seed, "vector_id") <= F.lit(SAMPLE_ROWS / rows))
        points = sample.select(as_ml_vector("vector").alias("features")).persist()
        try:
            model = KMeans(k=wanted, seed=seed, initMode="random", maxIter=max_iter).fit(points)
        finally:
            points.unpersist()
        centres = _unit(np.array(model.clusterCenters()))
    else:
        size = ready.agg(F.max(F.size("vector"))).first()[0] or 0
        centres = np.zeros((1, size))
    return CellIndex(centres, stored(_placed(ready, "vector_id", centres, 1), "cells"))


def search_index(
    index: CellIndex,
    queries: DataFrame,
    k: int,
    probes: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    exclude_same_id: bool = False,
) -> DataFrame:
    """The ``k`` most similar vectors in the ``probes`` nearest cells of every query.

    (query_id, rank, vector_id, similarity) as :func:`tagloom.operators.vectors.nearest_neighbours`, which is
    what this gives if all cells are searched. Queries without a vector have no neighbours.
    """
    asked = queries.select(as_column(query_id).alias("query_id"), fn.unit(query_vector).alias("vector")).filter(
        F.col("vector").isNotNull()
    )
    probes = min(probes, len(index.centres))
    # at most MOST_CELLS rows
    sizes = index.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    shelf_of, of_vectors = _shelves({r["cell"]: r["n"] for r in sizes}, len(index.centres))
    asked = _asked(asked, index.centres, probes, shelf_of)
    shelves = index.vectors.sparkSession.createDataFrame(
        [(c, int(shelf_of[c]), of_vectors[shelf_of[c]]) for c in sorted(r["cell"] for r in sizes)], "cell int, shelf int, of_vectors int"
    )
    # one row per cell, or per shelf
    pieces = shelves.join(F.broadcast(_pieces(asked, "shelf", PIECE_QUERIES, "of_queries")), "shelf")
    vectors = _dealt(index.vectors.join(F.broadcast(pieces), "cell"), "vector_id", "of_vectors", "of_queries", "v", "q")
    dealt = _dealt(
        asked.join(F.broadcast(pieces.drop("cell").distinct()), "shelf"), "query_id", "of_queries", "of_vectors", "q", "v"
    )
    keys = ("shelf", "v", "q")
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("vector_id", index.vectors.schema["vector_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    found = (
        vectors.select(*keys, "cell", "vector_id", "vector")
        .groupBy(*keys)
        .cogroup(dealt.select(*keys, "cells", "query_id", "query").groupBy(*keys))
        .applyInArrow(_best_in_piece(k + 1 if exclude_same_id else k), schema)
    )
    if exclude_same_id:
        found = found.filter(~F.col("query_id").eqNullSafe(F.col("vector_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vector_id", "similarity")


def probes_for(
    index: CellIndex,
    queries: DataFrame,
    k: int,
    recall: float = 0.95,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    exclude_same_id: bool = False,
    seed: int = 0,
) -> int:
    """How many cells must be searched to find this part of the true neighbours.

    Measured on about ``TUNE_QUERIES`` queries, drawn by a hash of their id: their exact neighbours are looked
    up, and then how far down a query's list of cells each of them lies.
    """
    asked = queries.select(as_column(query_id).alias("query_id"), fn.unit(query_vector).alias("query_vector"))
    asked = asked.filter(F.col("query_vector").isNotNull())
    share = min(1.0, TUNE_QUERIES / max(1, asked.count()))
    # drawn once: the same rows are asked and compared
    drawn = asked.filter(uniform(seed, "query_id") <= F.lit(share)).orderBy(F.xxhash64("query_id")).limit(2 * TUNE_QUERIES)
    rows = drawn.collect()
    if not rows:
        return 1
    asked = queries.sparkSession.createDataFrame(rows, drawn.schema)
    exact = nearest_neighbours(index.vectors, asked, k, "vector_id", "vector", exclude_same_id=exclude_same_id)
    # at most TUNE_QUERIES * 2 * k rows meet the ids of the index
    lies = index.vectors.select("vector_id", "cell").join(F.broadcast(exact), "vector_id")
    nearness = np.argsort(np.argsort(-np.array([r["query_vector"] for r in rows]) @ index.centres.T, axis=1, kind="stable"), axis=1)
    number = {r["query_id"]: i for i, r in enumerate(rows)}
    depths = sorted(int(nearness[number[r["query_id"]], r["cell"]]) for r in lies.select("query_id", "cell").collect())
    return depths[max(0, math.ceil(recall * len(depths)) - 1)] + 1 if depths else 1


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the part of the exact neighbours that ``found`` has, over all queries of ``exact``."""
    pair = [F.col("query_id"), F.col("vector_id")]
    hits = exact.select(*pair).join(found.select(*pair).distinct().withColumn("hit", F.lit(1)), ["query_id", "vector_id"], "left")
    return hits.agg(
        F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall")
    )


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _placed(df: DataFrame, name: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cell): a row for each of the ``probes`` nearest centres."""
    schema = df.select(name, "vector").schema.add("cell", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                near = _matrix(batch.column("vector")) @ centres.T
                cells = _nearest(near, probes)
                take = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                cell = pa.array(cells.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in (name, "vector")] + [cell], schema.names)

    return df.select(name, "vector").mapInArrow(run, schema)


def _shelves(sizes: dict[int, int], cells: int) -> tuple[np.ndarray, list[int]]:
    """The shelf of each cell (-1 for a cell without vectors), and into how many pieces each shelf is cut."""
    shelf_of, held = np.full(cells, -1), []
    for cell, n in sorted(sizes.items()):
        if not held or held[-1] + n > PIECE_VECTORS:
            held.append(0)
        held[-1] += n
        shelf_of[cell] = len(held) - 1
    return shelf_of, [math.ceil(n / PIECE_VECTORS) for n in held]


def _asked(df: DataFrame, centres: np.ndarray, probes: int, shelf_of: np.ndarray) -> DataFrame:
    """(query_id, query, shelf, cells): a row for each shelf that holds some of the ``probes`` nearest cells."""
    kinds = df.select("query_id", F.col("vector").alias("query")).schema
    schema = kinds.add("shelf", T.IntegerType()).add("cells", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches if (shelf_of >= 0).any() else ():
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                near = _matrix(batch.column("vector")) @ centres.T
                cells = _nearest(near, probes)
                row, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
                shelf = shelf_of[cell]
                order = np.lexsort((cell, shelf, row))
                order = order[shelf[order] >= 0]
                row, cell, shelf = row[order], cell[order], shelf[order]
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shelf, prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                take = pa.array(row[first])
                data = [batch.column(c).take(take) for c in ("query_id", "vector")]
                yield pa.RecordBatch.from_arrays([*data, pa.array(shelf[first].astype(np.int32)), lists], schema.names)

    return df.select("query_id", "vector").mapInArrow(run, schema)


def _nearest(near: np.ndarray, probes: int) -> np.ndarray:
    if probes >= near.shape[1]:
        return np.broadcast_to(np.arange(near.shape[1]), near.shape)
    return np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes > 1 else near.argmax(1)[:, None]


def _pieces(df: DataFrame, key: str, most: int, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))


def _dealt(df: DataFrame, row_id: str, own: str, others: str, own_name: str, other_name: str) -> DataFrame:
    """Each row to one piece of its own kind, and there once for every piece of the other kind."""
    piece: Column = F.pmod(F.xxhash64(row_id), F.col(own)).cast("int")
    return df.withColumn(own_name, piece).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))


def _best_in_piece(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vector_id", "similarity"]
        kinds = [queries.schema.field("query_id").type, vectors.schema.field("vector_id").type, pa.float64()]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        # by cell, and smallest ids first, so that ties are told by place
        vectors = vectors.sort_by("vector_id")
        held = np.asarray(vectors["cell"])
        by_cell = np.argsort(held, kind="stable")
        cells, starts = np.unique(held[by_cell], return_index=True)
        places = dict(zip(cells.tolist(), np.split(by_cell, starts[1:]), strict=True))
        matrix = _matrix(vectors["vector"])
        parts = []
        for at in range(0, queries.num_rows, STEP_QUERIES):
            some = queries.slice(at, STEP_QUERIES)
            asked = _matrix(some["query"])
            lists = some["cells"].combine_chunks()
            wanted = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(asked)), np.asarray(lists.value_lengths()))
            order = np.argsort(wanted, kind="stable")
            row, wanted = row[order], wanted[order]
            kinds, first = np.unique(wanted, return_index=True)
            # what the k-th best of a query reaches at least
            least, found = np.full(len(asked), -np.inf), []
            for cell, own in zip(kinds.tolist(), np.split(row, first[1:]), strict=True):
                if cell in places:
                    found.append(_best_in_cell(asked, own, matrix, places[cell], k, least))
            if found:
                rows, columns, values = _first(*[np.concatenate(x) for x in zip(*found, strict=True)], k)
                parts.append((rows + at, columns, values))
        rows, columns, values = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.array([], int)] * 2 + [np.array([])]
        return pa.table(
            [queries["query_id"].take(pa.array(rows)), vectors["vector_id"].take(pa.array(columns)), pa.array(values)], names=names
        )

    return run


def _best_in_cell(asked: np.ndarray, own: np.ndarray, matrix: np.ndarray, place: np.ndarray, k: int, least: np.ndarray):
    """Rows, places and values of the ``k`` vectors of a cell most like each of these queries, but for those that reach less than ``least``."""
    scores = asked[own] @ matrix[place].T
    own, scores = (x[scores.max(1) >= least[own]] for x in (own, scores))
    if scores.shape[1] >= k:
        least[own] = np.maximum(least[own], np.partition(scores, -k, axis=1)[:, -k])
    rows, columns = np.nonzero(scores >= least[own][:, None])
    return _first(own[rows], place[columns], scores[rows, columns], k)


def _first(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, k: int):
    """The ``k`` highest values of each row; of equal ones the first in place, and no more than ``k`` go on."""
    order = np.lexsort((columns, -values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], columns[keep], values[keep]
