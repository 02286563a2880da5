"""Support vector machines: linear, and with the RBF kernel by random Fourier features before a linear machine.

The machines of all classes are fitted together: one pass over the cached rows gives the loss and the slope of every class that has not
settled, added up in the tasks, so a pass sends one row per class to the driver whatever the number of rows.

The inner product of two rows of features is about exp(-gamma * distance ** 2), the more features the closer. Features
are worked out where a vector is read, so training costs what the linear machine costs.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import SPLIT_SEED
from tagloom.functions import arrays as fn

#: Random features, and rows whose features are worked out in one step.
FEATURES, STEP_ROWS = 512, 4_096
#: Steps that a direction follows from, least gain of a step (part of the loss), halvings of a step, and what a step must reach.
STEPS, GAIN, HALVINGS, REACHED = 10, 1e-6, 20, 1e-4


class _Descent:
    """L-BFGS for one class. ``point`` is where the loss is wanted next; ``told`` takes it."""

    def __init__(self, size: int, max_iter: int):
        self.best, self.loss, self.slope = np.zeros(size), np.inf, np.zeros(size)
        self.point, self.left, self.halved, self.done = self.best, max_iter, 0, False
        self.history: list[tuple[np.ndarray, np.ndarray]] = []

    def told(self, loss: float, slope: np.ndarray) -> None:
        along = self.slope @ (self.point - self.best)
        if loss > self.loss + REACHED * along:
            self.halved += 1
            self.done = self.halved > HALVINGS
            self.point = (self.best + self.point) / 2
            return
        gain = self.loss - loss
        moved, turned = self.point - self.best, slope - self.slope
        if np.isfinite(self.loss):
            self.left -= 1
            if moved @ turned > 1e-12:
                self.history = [*self.history, (moved, turned)][-STEPS:]
        self.best, self.loss, self.slope, self.halved = self.point, loss, slope, 0
        self.done = self.left <= 0 or gain <= GAIN * abs(loss) or not slope.any()
        self.point = self.best - self._direction()

    def _direction(self) -> np.ndarray:
        out, parts = self.slope.copy(), []
        for moved, turned in reversed(self.history):
            part = moved @ out / (moved @ turned)
            out -= part * turned
            parts.append(part)
        if self.history:
            moved, turned = self.history[-1]
            out *= moved @ turned / (turned @ turned)
        else:
            out /= max(1.0, np.linalg.norm(out))
        for (moved, turned), part in zip(self.history, reversed(parts), strict=True):
            out += (part - turned @ out / (moved @ turned)) * moved
        return out


def fit_machines(rows: DataFrame, max_iter: int, penalty: float = 0.0, standardize: bool = True) -> np.ndarray:
    """One linear machine for each class against the rest, from (label double, x array): a row of weights and intercept per class.

    The mean hinge loss, and ``penalty`` / 2 times the squared weights (of scaled features with ``standardize``).
    """
    summary = Summarizer.metrics("std").summary(array_to_vector("x"))
    seen = rows.agg(summary.alias("s"), F.max("label").alias("last"), F.count(F.lit(1)).alias("n")).first()
    width = seen["s"]["std"].toArray()
    scale = np.divide(1.0, width, out=np.zeros_like(width), where=width > 0)
    weigh = penalty * (np.ones_like(scale) if standardize else scale**2)
    classes = [_Descent(len(scale) + 1, max_iter) for _ in range(int(seen["last"]) + 1)]
    # every pass reads these: scaled, and many packed into one row
    packed = rows.select("label", "x").mapInArrow(_scaled(scale), "labels binary, xs binary").persist()
    try:
        return _descended(packed, classes, seen["n"], weigh) * np.append(scale, 1.0)
    finally:
        packed.unpersist()


def _descended(packed: DataFrame, classes: list[_Descent], n: int, weigh: np.ndarray) -> np.ndarray:
    """The best point of each class."""
    while moving := [k for k, c in enumerate(classes) if not c.done]:
        points = np.array([classes[k].point for k in moving])
        told = packed.mapInArrow(_hinge(np.array(moving), points), "place int, loss double, slope array<double>")
        # one row of sums per class
        summed = told.groupBy("place").agg(F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("slope")).alias("slope"))
        for row in summed.collect():
            w = points[row["place"]][:-1]
            slope = row["slope"].toArray() / n + np.append(weigh * w, 0.0)
            classes[moving[row["place"]]].told(row["loss"] / n + (weigh * w * w).sum() / 2, slope)
    return np.array([c.best for c in classes])


def _scaled(scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                x = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1) * scale
                columns = [np.asarray(batch.column("label"), np.float64).tobytes(), x.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["labels", "xs"])

    return run


def _hinge(labels: np.ndarray, points: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope = np.zeros(len(points)), np.zeros(points.shape)
        for batch in batches:
            for label, xs in zip(batch.column("labels"), batch.column("xs"), strict=True):
                x = np.frombuffer(xs.as_buffer(), np.float64).reshape(-1, points.shape[1] - 1)
                sign = np.where(np.frombuffer(label.as_buffer(), np.float64)[:, None] == labels, 1.0, -1.0)
                lacks = 1.0 - sign * (x @ points[:, :-1].T + points[:, -1])
                loss += np.maximum(lacks, 0.0).sum(0)
                push = np.where(lacks > 0, -sign, 0.0)
                slope[:, :-1] += push.T @ x
                slope[:, -1] += push.sum(0)
        place = pa.array(np.arange(len(points), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([place, pa.array(loss), pa.array(list(slope), pa.list_(pa.float64()))], ["place", "loss", "slope"])

    return run


def most_likely(machines: np.ndarray, vector: Column) -> Column:
    """The class whose machine gives an array the highest score; null for null."""

    @F.pandas_udf("double")
    def best(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            values, out = part.to_numpy(), np.full(len(part), np.nan)
            known = np.flatnonzero(part.notna().to_numpy())
            for at in range(0, len(known), STEP_ROWS):
                rows = known[at : at + STEP_ROWS]
                out[rows] = (np.stack(values[rows]) @ machines[:, :-1].T + machines[:, -1]).argmax(1)
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    return best(vector)


class KernelFeatures:
    """Random directions and phases for one number of dimensions."""

    def __init__(self, dimensions: int, gamma: float, features: int = FEATURES, seed: int = SPLIT_SEED):
        random = np.random.default_rng(seed)
        self.directions = random.normal(0.0, np.sqrt(2.0 * gamma), (dimensions, features))
        self.phases = random.uniform(0.0, 2.0 * np.pi, features)

    def of(self, matrix: np.ndarray) -> np.ndarray:
        """The features of each row."""
        return np.sqrt(2.0 / len(self.phases)) * np.cos(matrix @ self.directions + self.phases)

    def column(self, vector: Column) -> Column:
        """The features of an array column, as an array; null for null."""

        @F.pandas_udf("array<double>")
        def features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                values, out = part.to_numpy(), [None] * len(part)
                known = np.flatnonzero(part.notna().to_numpy())
                for at in range(0, len(known), STEP_ROWS):
                    rows = known[at : at + STEP_ROWS]
                    for row, found in zip(rows, self.of(np.stack(values[rows])), strict=True):
                        out[row] = found
                yield pd.Series(out, dtype=object)

        return features(vector)


def spread_gamma(df: DataFrame, vector: str) -> float:
    """1 / (dimensions * variance of all entries), the usual width of the kernel; one pass."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(_vector(df, vector))
    # grouped by a constant, because an empty frame has no summary
    found = df.groupBy(F.lit("all")).agg(summary.alias("s")).first()
    if found is None:
        return 1.0
    row = found["s"]
    means, n = row["mean"].toArray(), row["count"]
    inside = row["variance"].toArray() * (n - 1) / n
    whole = inside.mean() + (means**2).mean() - means.mean() ** 2
    return float(1.0 / (len(means) * whole)) if whole > 0 else 1.0


class LinearSVM:
    """Fits like the other classifiers: one machine per class against the rest, without a penalty."""

    def __init__(self, max_iter: int = 100):
        self.max_iter = max_iter
        self.features_column, self.label_column, self.prediction_column = "features", "label", "prediction"

    def copy(self):
        return copy.copy(self)

    def setFeaturesCol(self, name: str):  # noqa: N802  (as Spark's own classifiers)
        self.features_column = name
        return self

    def setLabelCol(self, name: str):  # noqa: N802
        self.label_column = name
        return self

    def setPredictionCol(self, name: str):  # noqa: N802
        self.prediction_column = name
        return self

    def fit(self, train: DataFrame) -> SVMModel:
        known = self._known(train)
        return self._fitted(known, None, 0.0)

    def _known(self, train: DataFrame) -> DataFrame:
        return train.filter(F.col(self.features_column).isNotNull() & F.col(self.label_column).isNotNull())

    def _fitted(self, known: DataFrame, kernel: KernelFeatures | None, penalty: float) -> SVMModel:
        x = _array(known, self.features_column)
        # every pass reads the features, so they are worked out once
        ready = known.select(F.col(self.label_column).cast("double").alias("label"), (kernel.column(x) if kernel else x).alias("x")).persist()
        try:
            if ready.isEmpty():
                raise ValueError("no row to learn from")
            machines = fit_machines(ready, self.max_iter, penalty, standardize=kernel is None)
        finally:
            ready.unpersist()
        return SVMModel(kernel, machines, self.features_column, self.prediction_column)


class KernelSVM(LinearSVM):
    """The same on random features.

    ``cost`` weighs the errors as usual (1 by default). Without ``gamma`` it follows from the training rows.
    """

    def __init__(
        self, features: int = FEATURES, gamma: float | None = None, cost: float = 1.0, max_iter: int = 100, seed: int = SPLIT_SEED,
    ):
        super().__init__(max_iter)
        self.features, self.gamma, self.cost, self.seed = features, gamma, cost, seed

    def fit(self, train: DataFrame) -> SVMModel:
        known = self._known(train)
        size = known.select(F.size(_array(known, self.features_column)).alias("n")).agg(F.max("n"), F.count("n")).first()
        if not size[1]:
            raise ValueError("no row to learn from")
        gamma = self.gamma or spread_gamma(known, self.features_column)
        kernel = KernelFeatures(size[0], gamma, self.features, self.seed)
        return self._fitted(known, kernel, 1.0 / (self.cost * size[1]))


class SVMModel:
    def __init__(self, kernel: KernelFeatures | None, machines: np.ndarray, features: str, prediction: str):
        self.kernel, self.machines, self.features, self.prediction = kernel, machines, features, prediction

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the predicted class number."""
        x = _array(df, self.features)
        return df.withColumn(self.prediction, most_likely(self.machines, self.kernel.column(x) if self.kernel else x))


def _is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, VectorUDT)


def _array(df: DataFrame, name: str) -> Column:
    return vector_to_array(F.col(name)) if _is_vector(df, name) else fn.doubles(name)


def _vector(df: DataFrame, name: str) -> Column:
    return F.col(name) if _is_vector(df, name) else array_to_vector(fn.doubles(name))
