"""Vectors: pooling, normalising, distances and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.constants import ENGLISH_STOP_WORDS
from tagloom.functions import arrays as fn
from tagloom.functions import text as words
from tagloom.functions.values import ColumnOrName, as_column
from tagloom.operators.joins import fits, lookup_join, spread_join

VECTOR_BYTES = 256 * 1024 * 1024
QUERY_ROWS = 4_096
#: Vectors that a task compares with a block of queries in one step.
STEP_ROWS = 1_024


def vector_dimensions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Length of the vectors of every method: (name, dimension)."""
    longest = df.agg(*[F.max(F.size(as_column(c))).alias(c) for c in columns])
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), as_column(c).alias("dimension")) for c in columns]
    )
    return longest.select(F.inline(cells))


def l2_normalize(df: DataFrame, vector: str, name: str | None = None) -> DataFrame:
    """Scale vectors to length 1; zero vectors stay."""
    return df.withColumn(name or vector, fn.unit(vector))


def mean_vector(
    df: DataFrame, group: str, vector: str, name: str = "vector", weight: str | None = None
) -> DataFrame:
    """Mean vector per group. Partial sums are built before the shuffle, one vector per group."""
    as_vector = array_to_vector(fn.doubles(vector))
    mean = (
        Summarizer.mean(as_vector, as_column(weight).cast("double"))
        if weight
        else Summarizer.mean(as_vector)
    )
    return df.groupBy(as_column(group)).agg(vector_to_array(mean).alias(name))


def token_vectors(
    tokens: DataFrame, vectors: DataFrame, token: str = "token", vector: str = "vector"
) -> DataFrame:
    """Tokens that have a vector, with it; others are left out."""
    table = vectors.select(as_column(token), as_column(vector))
    return lookup_join(tokens, table, [token], max_rows=5_000_000, max_bytes=VECTOR_BYTES)


def document_embedding(
    df: DataFrame,
    sample_id: str,
    text: str,
    vectors: DataFrame,
    dimension: int,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    normalize_tokens: bool = True,
    count_unknown: bool = False,
    name: str = "vector",
) -> DataFrame:
    """Mean of the token vectors of a text: (sample_id, vector); zeros when no token has one.

    ``normalize_tokens`` scales every token vector to length 1 first. ``count_unknown`` divides by
    all tokens, so that a token without vector pulls the mean towards zero.
    """
    sid = as_column(sample_id).alias("sample_id")
    found_words = words.tokens(text, stop_words)
    table = vectors.select(
        "token", (fn.unit("vector") if normalize_tokens else fn.doubles("vector")).alias("vector")
    )
    tokens = fn.unnest(df, found_words, [sid], "token")
    if fits(table, 5_000_000, VECTOR_BYTES):
        # the words of a text stay in one task, which adds them up before the shuffle
        found = tokens.join(F.broadcast(table), "token").withColumn("n", F.lit(1))
    else:
        counted = tokens.groupBy("sample_id", "token").agg(F.count(F.lit(1)).alias("n"))
        found = spread_join(counted, table, ["token"])
    pooled = found.groupBy("sample_id").agg(
        vector_to_array(
            Summarizer.mean(array_to_vector(F.col("vector")), F.col("n").cast("double"))
        ).alias("__mean"),
        F.sum("n").alias("__known"),
    )
    texts = df.select(sid, F.size(found_words).alias("__all")) if count_unknown else df.select(sid)
    joined = texts.join(pooled, "sample_id", "left")
    mean = F.col("__mean")
    if count_unknown:
        share = F.col("__known") / F.col("__all")
        mean = F.transform(mean, lambda x: x * share)
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return joined.select("sample_id", F.coalesce(mean, zeros).alias(name))


def pair_distance(
    pairs: DataFrame, vectors: DataFrame, vector_id: str, vector: str, a: str = "a", b: str = "b"
) -> DataFrame:
    """Euclidean distance and cosine for given pairs of ids."""
    def side(which: str) -> DataFrame:
        return vectors.select(as_column(vector_id).alias(which), as_column(vector).alias(f"__{which}"))

    found = spread_join(spread_join(pairs, side(a), [a]), side(b), [b])
    return found.select(
        *[as_column(c) for c in pairs.columns],
        fn.distance(f"__{a}", f"__{b}").alias("distance"),
        fn.cosine(f"__{a}", f"__{b}").alias("similarity"),
    )


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector_id: str,
    vector: str,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    query_rows: int = QUERY_ROWS,
    exclude_same_id: bool = False,
) -> DataFrame:
    """The ``k`` vectors with the highest cosine for every query, exact.

    (query_id, rank, vector_id, similarity); ties go to the smaller id. ``exclude_same_id`` leaves
    out the vector with the query's own id. A block of queries is
    sent to every task; each task multiplies it with its vectors and passes on ``k`` rows per
    query. Queries beyond one block are taken block by block, so their number only adds passes.
    """
    query_type = queries.schema[query_id].dataType
    id_type = vectors.schema[vector_id].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("vector_id", id_type),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    corpus = vectors.select(
        as_column(vector_id).alias("vector_id"), fn.doubles(vector).alias("vector")
    )
    asked = queries.select(
        as_column(query_id).alias("query_id"), fn.doubles(query_vector).alias("vector")
    )
    wanted = k + 1 if exclude_same_id else k
    blocks = max(1, math.ceil(asked.count() / query_rows))
    best = None
    for number in range(blocks):
        block = asked
        if blocks > 1:
            block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        rows = block.collect()  # about query_rows of them
        if not rows:
            continue
        found = corpus.mapInPandas(_best_in_part(rows, wanted), schema)
        best = found if best is None else best.unionAll(found)
    if best is None:
        best = corpus.sparkSession.createDataFrame([], schema)
    if exclude_same_id:
        best = best.filter(F.col("query_id") != F.col("vector_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vector_id", "similarity")
    )


def _best_in_part(rows: list, k: int):
    """Function for mapInPandas: best ``k`` of one partition for every query."""
    query_ids = np.array([r["query_id"] for r in rows], dtype=object)

    def unit_rows(matrix: np.ndarray) -> np.ndarray:
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)

    def keep(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # best k per query; equal scores by id
        if scores.shape[1] <= k:
            return ids, scores
        chosen = np.argpartition(scores, -k, axis=1)[:, -k:]
        kth = np.take_along_axis(scores, chosen, 1).min(1)
        for row in np.flatnonzero((scores >= kth[:, None]).sum(1) > k):
            near = np.flatnonzero(scores[row] >= kth[row])
            chosen[row] = sorted(near, key=lambda j: (-scores[row, j], ids[row, j]))[:k]
        return np.take_along_axis(ids, chosen, 1), np.take_along_axis(scores, chosen, 1)

    asked = unit_rows(np.array([r["vector"] for r in rows], dtype="float64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.empty((len(query_ids), 0), dtype=object)
        scores = np.empty((len(query_ids), 0))
        # never more scores at once than a block of queries has with a few vectors
        for batch in (whole.iloc[at : at + STEP_ROWS] for whole in batches for at in range(0, len(whole), STEP_ROWS)):
            block = unit_rows(np.stack(batch["vector"].to_numpy()).astype("float64"))
            batch_ids = batch["vector_id"].to_numpy(dtype=object)
            ids = np.hstack([ids, np.broadcast_to(batch_ids, (len(query_ids), len(batch)))])
            scores = np.hstack([scores, asked @ block.T])
            ids, scores = keep(ids, scores)
        if ids.shape[1]:
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(query_ids, ids.shape[1]),
                    "vector_id": ids.ravel(),
                    "similarity": scores.ravel(),
                }
            )

    return run


def as_ml_vector(c: ColumnOrName) -> Column:
    return array_to_vector(fn.doubles(c))
