import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tagloom.operators import classify, kernels


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(60, 5))
    kernel = kernels.KernelFeatures(5, 0.3, features=20_000)
    found = kernel.of(points)
    distances = ((points[:, None] - points[None]) ** 2).sum(2)
    assert np.abs(found @ found.T - np.exp(-0.3 * distances)).max() < 0.05


def test_gamma(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(3, 2, (200, 4))
    df = spark.createDataFrame([(row.tolist(),) for row in matrix], "v array<double>")
    assert kernels.spread_gamma(df, "v") == pytest.approx(1 / (4 * matrix.var()))
    assert kernels.spread_gamma(df.select(array_to_vector("v").alias("v")), "v") == pytest.approx(1 / (4 * matrix.var()))
    assert kernels.spread_gamma(df.select(F.lit([1.0, 1.0]).alias("v")), "v") == 1.0
    assert kernels.spread_gamma(df.limit(0), "v") == 1.0


@pytest.fixture(scope="module")
def rings(spark):
    """A disc, a ring around it and the corner points: no straight line parts them."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        kind, angle = i % 3, rng.uniform(0, 2 * np.pi)
        radius = (0.5, 2.0, 3.5)[kind] + rng.normal(0, 0.15)
        rows.append((i, [float(radius * np.cos(angle)), float(radius * np.sin(angle))], kind))
    return spark.createDataFrame(rows, "id int, v array<double>, y int").repartition(4).cache()


def accuracy(model, df):
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    train, test = classify.robust_scale(train, test, vector="v", name="x")
    found = classify.fit_predict(model, train, test, "x", "y", "p")
    assert set(found.columns) == {"id", "v", "y", "x", "p"}
    return found.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0]


def test_kernel_parts_rings_that_a_line_does_not(rings):
    curved = accuracy(kernels.KernelSVM(features=200, max_iter=30), rings)
    straight = accuracy(classify.classifiers(svm_iterations=20)[classify.SVM], rings)
    assert curved > 0.95 and straight < 0.75


def test_on_arrays_and_nulls(spark, rings):
    model = kernels.KernelSVM(features=64, max_iter=10).setFeaturesCol("v").setLabelCol("y").setPredictionCol("p").fit(rings)
    odd = spark.createDataFrame([(1, [0.1, 0.2])], "id int, v array<double>")
    assert model.transform(odd).first()["p"] == 0.0
    with pytest.raises(ValueError):
        kernels.KernelSVM().setFeaturesCol("v").setLabelCol("y").fit(rings.limit(0))


def test_all_classes_are_fitted_in_the_same_passes(rings):
    """A pass serves every class: no more passes than the slowest class takes alone, and one row per class is collected."""
    passes = []
    rows = rings.select(F.col("y").cast("double").alias("label"), F.col("v").alias("x")).cache()

    def counted(*a, make=kernels._hinge):
        passes.append(len(a[0]))
        return make(*a)

    kernels._hinge, kept = counted, kernels._hinge
    try:
        machines = kernels.fit_machines(rows, 15)
    finally:
        kernels._hinge = kept
    assert machines.shape == (3, 3) and passes[0] == 3 and len(passes) <= 15 * 3
    x, y = np.array([r["x"] for r in rows.collect()]), np.array([r["label"] for r in rows.collect()])
    sign = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    loss = np.maximum(0, 1 - sign * (x @ machines[:, :-1].T + machines[:, -1])).mean(0)
    assert (loss <= 1.0).all() and np.isfinite(loss).all()


def test_passes_read_packed_rows(rings):
    """Each pass of a machine reads a row per step of vectors, not one per vector."""
    rows = rings.select(F.col("y").cast("double").alias("label"), F.col("v").alias("x")).coalesce(1)
    n = rows.count()
    packed = rows.mapInArrow(kernels._scaled(np.array([2.0, 0.5])), "labels binary, xs binary").collect()
    assert len(packed) == -(-n // kernels.STEP_ROWS)
    x = np.concatenate([np.frombuffer(r["xs"]).reshape(-1, 2) for r in packed])
    label = np.concatenate([np.frombuffer(r["labels"]) for r in packed])
    want = rows.collect()
    assert np.allclose(x, np.array([r["x"] for r in want]) * [2.0, 0.5]) and label.tolist() == [r["label"] for r in want]
