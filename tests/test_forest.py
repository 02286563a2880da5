import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import classify, forest


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes by two of nine features, and labels that follow from nothing for a tenth of the rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 9))
    y = (x[:, 0] > 0).astype(int) + ((x[:, 0] > 0) & (x[:, 1] > 0.5))
    y = np.where(rng.random(1200) < 0.1, rng.integers(0, 3, 1200), y)
    data = [(i, int(y[i]), x[i].tolist()) for i in range(1200)]
    return spark.createDataFrame(data, "id int, y int, v array<double>").repartition(2).cache()


def fitted(train, trees=6, depth=30):
    model = forest.RandomForest(trees, depth).setFeaturesCol("v").setLabelCol("y").setPredictionCol("p")
    return model.fit(train)


def test_large_and_small_nodes_make_the_same_forest(rows, monkeypatch):
    train, test = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    whole = {r.id: r.p for r in fitted(train).transform(test).collect()}
    part = 200
    monkeypatch.setattr(forest, "PART_ROWS", part)
    monkeypatch.setattr(forest, "PIECE_ROWS", 50)
    monkeypatch.setattr(forest, "PACKED_ROWS", 40)
    monkeypatch.setattr(forest, "PASS_NUMBERS", 3_000)
    model = fitted(train)
    # no task is given more than a part of the rows, and the driver only holds the splits above the parts
    most = model.parts.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    assert most >= 900 * 0.6 / part
    found = {r.id: r.p for r in model.transform(test).collect()}
    assert found == whole
    right = test.collect()
    assert np.mean([found[r.id] == r.y for r in right]) > 0.75


def test_trees_grow_until_rows_are_told_apart(rows):
    model = fitted(rows, trees=3)
    share = model.parts.select(F.explode("share").alias("s")).agg(F.avg((F.col("s") == 1.0).cast("int"))).first()[0]
    assert share > 0.95
    shallow = fitted(rows, trees=3, depth=2).parts.select(F.max(F.size("feature")).alias("n")).first()[0]
    assert shallow <= 7


def test_odd_tables(spark, rows):
    schema = "id int, y int, v array<double>"
    one = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])], schema)
    asked = spark.createDataFrame([(5, 1, [3.0, 0.0]), (5, 1, [3.0, 0.0]), (6, 0, None)], schema)
    assert sorted((r.id, r.p) for r in fitted(one).transform(asked).collect() if r.p is not None) == [(5, 0.0)] * 2
    assert fitted(one).transform(asked).filter("p IS NULL").count() == 1
    assert fitted(one).transform(asked.limit(0)).count() == 0
    # equal vectors can't be split, so a leaf votes for both
    same = spark.createDataFrame([(i, int(i % 3 == 0), [1.0, 2.0]) for i in range(60)], schema)
    assert {r.p for r in fitted(same, trees=20).transform(same).collect()} == {0.0}
    with pytest.raises(ValueError):
        fitted(one.limit(0))
    with pytest.raises(Exception, match="must not be null"):
        fitted(asked)


def test_the_compared_forest_does_not_send_trees_to_the_driver():
    assert isinstance(classify.classifiers()[classify.RANDOM_FOREST], forest.RandomForest)


def test_the_grid_fits_its_classifiers_beside_each_other(rows):
    """Each of two classifiers waits for the other."""
    meet = threading.Barrier(2)

    class Waiting(forest.RandomForest):
        def fit(self, train):
            meet.wait(60)
            return super().fit(train)

    models = {"a": Waiting(2, 3), "b": Waiting(3, 3)}
    found = classify.classifier_grid(rows, ["v"], "y", "id", models).collect()
    assert sorted((r.embedding, r.classifier) for r in found) == [("v", "a"), ("v", "b")]
    assert all(0.5 < r.accuracy <= 1 for r in found)


def test_the_decision_tree_learns_every_row(spark, monkeypatch):
    """Grown in tasks from every row and all features: of different rows with few values none is told wrong, however labels fall."""
    rng = np.random.default_rng(3)
    data = [(i, [5.0, float(i)], int(y)) for i, y in enumerate(rng.integers(0, 3, 30))]
    rows = spark.createDataFrame(data, "id int, v array<double>, y int").repartition(3)
    tree = classify.classifiers()[classify.DECISION_TREE]
    assert isinstance(tree, forest.DecisionTree)
    for most in (1 << 16, 8):
        monkeypatch.setattr(forest, "PART_ROWS", most)
        told = classify.fit_predict(tree, rows, rows, "v", "y", "p").collect()
        assert len(told) == 30 and all(r.p == r.y for r in told)
