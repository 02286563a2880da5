"""Clustering: K-means, two principal components, cluster reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.constants import CLUSTER_SEED, CLUSTERS, ELBOW_MAX_K
from tagloom.functions import arrays as fn
from tagloom.functions.values import as_column
from tagloom.operators.vectors import as_ml_vector

#: Starts that are looked for beside each other, and rows that are compared with all centres in one step.
FITS_AT_ONCE, STEP_ROWS = 8, 1 << 12
#: Rounds in which candidates for starts are drawn, and how many in one at least (else two for each cluster).
ROUNDS, DRAWN = 2, 64
#: How far the centres of a fit that has settled may still move in a step (as in Spark's K-means).
SETTLED = 1e-4


def kmeans(
    df: DataFrame,
    vector: str,
    k: int = CLUSTERS,
    seed: int = CLUSTER_SEED,
    name: str = "cluster",
    max_iter: int = 300,
) -> DataFrame:
    """Adds the cluster number. Only the vectors are cached, and only while the centres are fitted."""
    points = df.select(as_ml_vector(vector).alias("__features")).persist()
    try:
        model = KMeans(
            k=k, seed=seed, initMode="k-means||", maxIter=max_iter,
            featuresCol="__features", predictionCol=name,
        ).fit(points)
    finally:
        points.unpersist()
    return model.transform(df.withColumn("__features", as_ml_vector(vector))).drop("__features")


def pca_2d(df: DataFrame, vector: str, name: str = "pca") -> DataFrame:
    """Adds the first two principal components of the centred vectors."""
    points = df.select(as_ml_vector(vector).alias("__features")).persist()
    try:
        model = PCA(k=2, inputCol="__features", outputCol="__projected").fit(points)
        mean = points.agg(Summarizer.mean(F.col("__features")).alias("m")).first()["m"]
    finally:
        points.unpersist()
    # the model projects without centring, so the projected mean is taken off afterwards
    shift = model.pc.toArray().T @ mean.toArray()
    centred = fn.difference(
        vector_to_array("__projected"), F.array(*[F.lit(float(x)) for x in shift])
    )
    prepared = model.transform(df.withColumn("__features", as_ml_vector(vector)))
    return prepared.withColumn(name, centred).drop("__features", "__projected")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster."""
    return df.groupBy(as_column(cluster)).agg(F.count(F.lit(1)).alias("n"))


def cluster_composition(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Rows per cluster and label, largest first within a cluster."""
    counted = df.groupBy(as_column(cluster), as_column(label)).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(as_column(cluster), F.desc("n"), as_column(label))


def cluster_sse(
    df: DataFrame, vector: str, cluster: str, dimensions: int | None = None
) -> DataFrame:
    """Squared distances to the cluster mean, summed per cluster: (cluster, n, sse).

    One pass: the variance per dimension times its degrees of freedom is that sum. ``dimensions``
    looks at the first few only.
    """
    values = fn.doubles(vector)
    if dimensions:
        values = F.slice(values, 1, dimensions)
    summary = Summarizer.metrics("count", "variance").summary(array_to_vector(values))
    return (
        df.groupBy(as_column(cluster).alias("cluster"))
        .agg(summary.alias("s"))
        .select(
            "cluster",
            F.col("s.count").alias("n"),
            (
                F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda t, x: t + x)
                * (F.col("s.count") - 1)
            ).alias("sse"),
        )
    )


def elbow(
    df: DataFrame,
    vector: str,
    max_k: int = ELBOW_MAX_K,
    seed: int = CLUSTER_SEED,
    dimensions: int | None = None,
    max_iter: int = 300,
) -> DataFrame:
    """Squared distances to the centres for 1 to ``max_k`` clusters: (k, sse).

    As in k-means||, vectors are drawn by their distance from those drawn before, weighed by the vectors nearest to them, and
    Spark's K-means finds the starts among them; but all k share what is drawn, enough for the largest. ``FITS_AT_ONCE`` of these
    small fits run beside each other. The steps from there are those of Spark's fits, but one pass over the vectors takes
    a step for every k that has not settled, and sends one row per k to the driver.
    """
    spark = df.sparkSession
    prepared = df.select(as_ml_vector(vector).alias("features")).persist()
    packed = None
    try:
        # one cluster needs no fit: its centre is the mean; this also fills the cache
        whole = prepared.select(vector_to_array("features").alias("v"), F.lit(0).alias("c"))
        rows = [(1, float(cluster_sse(whole, "v", "c", dimensions).first()["sse"]))]
        if max_k > 1:
            mean = prepared.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
            packed = whole.select("v").mapInArrow(_less(mean), "rows binary").persist()
            drawn, weights = _candidates(packed, len(mean), max(DRAWN, 2 * max_k), seed)
            prepared.unpersist()
            told = [(Vectors.dense(x), float(n)) for x, n in zip(drawn, weights, strict=True)]
            # as many rows as were drawn
            few = spark.createDataFrame(told, T.StructType().add("features", VectorUDT()).add("n", "double")).coalesce(1)

            def start_of(k: int) -> np.ndarray:
                return np.array(KMeans(k=k, seed=seed, initMode="k-means||", weightCol="n").fit(few).clusterCenters())

            sizes = range(max_k, 1, -1)
            with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
                starts = dict(zip(sizes, pool.map(start_of, sizes), strict=True))
            rows += sorted(_settled(packed, starts, max_iter, dimensions).items())
    finally:
        prepared.unpersist()
        if packed is not None:
            packed.unpersist()
    return spark.createDataFrame(rows, "k int, sse double")


def _candidates(packed: DataFrame, size: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``n`` vectors of each round, the further from the mean and those drawn before the likelier, and how many are nearest to each."""
    found = np.zeros((1, size))
    for number in range(ROUNDS):
        ((_, _, cost),) = _step(packed, {0: found}).values()
        if cost <= 0:
            break
        drawn = packed.mapInArrow(_far(found, n / cost, [seed, number]), "v array<double>").collect()  # about n rows
        found = np.unique(np.concatenate([found, np.array([r["v"] for r in drawn]).reshape(-1, size)]), axis=0)
    ((_, counts, _),) = _step(packed, {0: found}).values()
    return found[counts > 0], counts[counts > 0]


def _far(found: np.ndarray, share: float, seed: list[int]):
    half = (found**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([*seed, TaskContext.get().partitionId()])
        for batch in batches:
            for row in batch.column("rows"):
                x = np.frombuffer(row.as_buffer(), np.float64).reshape(-1, found.shape[1])
                away = (x * x).sum(1) - 2 * (x @ found.T - half).max(1)
                taken = x[random.random(len(x)) < share * away]
                yield pa.RecordBatch.from_arrays([pa.array(list(taken), pa.list_(pa.float64()))], ["v"])

    return run


def _settled(packed: DataFrame, centres: dict[int, np.ndarray], max_iter: int, dimensions: int | None) -> dict[int, float]:
    """Lloyd's steps from the given centres of each k; the squared distances that the last step met, as in Spark's summary.
    With ``dimensions`` those to the last centres, in the first dimensions."""
    centres, cost = dict(centres), dict.fromkeys(centres, 0.0)
    moving = sorted(centres)
    for _ in range(max_iter):
        told, still = _step(packed, {k: centres[k] for k in moving}), []
        for k in moving:
            sums, counts, cost[k] = told[k]
            # a centre without vectors stays
            new = np.divide(sums, counts[:, None], out=centres[k].copy(), where=counts[:, None] > 0)
            if ((new - centres[k]) ** 2).sum(1).max() > SETTLED**2:
                still.append(k)
            centres[k] = new
        if not (moving := still):
            break
    if dimensions is not None:
        cost = {k: c for k, (_, _, c) in _step(packed, centres, dimensions).items()}
    return cost


def _step(packed: DataFrame, centres: dict[int, np.ndarray], dimensions: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each k the sums and numbers of the vectors nearest to each centre, and their squared distances."""
    told = packed.mapInArrow(_nearest(centres, dimensions), "k int, sums array<double>")
    summed = told.groupBy("k").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
    out = {}
    for row in summed.collect():  # one per k
        n, size = centres[row["k"]].shape
        values = row["s"].toArray()
        out[row["k"]] = values[: n * size].reshape(n, size), values[n * size : -1], float(values[-1])
    return out


def _less(mean: np.ndarray):
    """Vectors less the mean, many packed into a row: distances stay, and near the origin they lose no digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                values = whole.column("v").slice(at, STEP_ROWS)
                x = np.asarray(values.flatten(), np.float64).reshape(len(values), -1) - mean
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["rows"])

    return run


def _nearest(centres: dict[int, np.ndarray], dimensions: int | None):
    every = np.concatenate(list(centres.values()))
    ends = np.cumsum([len(c) for c in centres.values()])
    half = (every**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, cost = np.zeros_like(every), np.zeros(len(every)), np.zeros(len(ends))
        for batch in batches:
            for row in batch.column("rows"):
                x = np.frombuffer(row.as_buffer(), np.float64).reshape(-1, every.shape[1])
                near, own = x @ every.T - half, np.zeros((len(x), len(every)))
                line, square = np.arange(len(x)), (x * x).sum()
                for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    best = near[:, start:end].argmax(1) + start
                    own[line, best] = 1.0
                    if dimensions is None:
                        cost[i] += square - 2 * near[line, best].sum()
                    else:
                        cost[i] += ((x[:, :dimensions] - every[best, :dimensions]) ** 2).sum()
                sums += own.T @ x
                counts += own.sum(0)
        parts = zip(centres, [0, *ends[:-1]], ends, cost, strict=True)
        told = [(k, np.concatenate([sums[a:b].ravel(), counts[a:b], [c]])) for k, a, b, c in parts]
        columns = [pa.array([k for k, _ in told], pa.int32()), pa.array([v for _, v in told], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["k", "sums"])

    return run


def cluster_all_methods(
    df: DataFrame,
    methods: Sequence[str],
    k: int = CLUSTERS,
    seed: int = CLUSTER_SEED,
    max_iter: int = 300,
) -> DataFrame:
    """Adds ``{method}_cluster`` and ``{method}_pca`` for every vector column."""
    out = df
    for method in methods:
        scaled = out.withColumn("__unit", fn.unit(method))
        placed = kmeans(scaled, "__unit", k, seed, f"{method}_cluster", max_iter)
        out = pca_2d(placed, "__unit", f"{method}_pca").drop("__unit")
    return out
