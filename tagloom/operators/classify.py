"""Classifiers on vectors and on tags, and batch scoring with a model the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import RobustScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.constants import ENGLISH_STOP_WORDS, SPLIT_SEED, SPLIT_TEST_SIZE
from tagloom.functions import arrays as fn
from tagloom.functions import text as words
from tagloom.functions.values import as_column
from tagloom.operators.evaluate import accuracy_matrix
from tagloom.operators.forest import DecisionTree, RandomForest
from tagloom.operators.joins import lookup_join
from tagloom.operators.kernels import KernelSVM, LinearSVM
from tagloom.operators.labels import encode_labels, train_test_split
from tagloom.operators.vectors import as_ml_vector, l2_normalize, mean_vector
from tagloom.session import stored
from tagloom.sources.readers import PREDICTION_SCHEMA

LOGISTIC_REGRESSION = "Logistic_Regression"
SVM = "Support_Vector_Machine"
RANDOM_FOREST = "Random_Forest"
DECISION_TREE = "Decision_Tree"
#: Classifiers that are fitted beside each other.
FITS_AT_ONCE = 4
#: Numbers of class means in a block that goes to every task, and tags that are compared in one step.
CLASS_NUMBERS, TAG_ROWS = 1 << 22, 1 << 11


def classifiers(
    seed: int = SPLIT_SEED, max_depth: int = 30, trees: int = 100, svm_iterations: int = 100, kernel: str = "linear"
) -> dict:
    """The four compared classifiers. ``kernel="rbf"`` gives the support vector machine a curved border."""
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"no kernel {kernel!r}")
    linear = LinearSVM(max_iter=svm_iterations)
    return {
        LOGISTIC_REGRESSION: LogisticRegression(family="multinomial", maxIter=400),
        SVM: linear if kernel == "linear" else KernelSVM(max_iter=svm_iterations, seed=seed),
        RANDOM_FOREST: RandomForest(trees, max_depth, seed),
        DECISION_TREE: DecisionTree(max_depth, seed),
    }


def robust_scale(train: DataFrame, *frames: DataFrame, vector: str, name: str) -> list[DataFrame]:
    """Centre on the median and divide by the quartile range, both of the training rows.

    A feature without range is only centred; Spark's own scaler would set it to zero.
    """
    model = RobustScaler(
        inputCol="__in", outputCol="__out", withCentering=True, withScaling=True
    ).fit(train.select(as_ml_vector(vector).alias("__in")))
    # one (median, range) pair per feature
    median = F.array(*[F.lit(float(x)) for x in model.median])
    width = F.array(*[F.lit(float(x) or 1.0) for x in model.range])
    scaled = F.zip_with(fn.difference(vector, median), width, lambda x, w: x / w)
    return [df.withColumn(name, array_to_vector(scaled)) for df in (train, *frames)]


def fit_predict(
    classifier, train: DataFrame, test: DataFrame, features: str, label: str, name: str
) -> DataFrame:
    """Fit on one frame, add the predicted label number to the other."""
    ready = classifier.copy()
    ready.setFeaturesCol(features).setLabelCol(label).setPredictionCol(name)
    extra = [c for c in ("rawPrediction", "probability") if c not in test.columns]
    predicted = ready.fit(train).transform(test)
    return predicted.withColumn(name, F.col(name).cast("int")).drop(*extra)


def classifier_grid(
    df: DataFrame,
    embeddings: Sequence[str],
    label: str,
    sample_id: str,
    models: dict | None = None,
    test_size: float = SPLIT_TEST_SIZE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Accuracy of every classifier on every vector column: (embedding, classifier, accuracy).

    All columns share one split. A split is scaled and cached once per vector column. The steps of most fits are short jobs,
    one after the other, so ``FITS_AT_ONCE`` of them run beside each other.
    """
    models = models or classifiers(seed)
    spark = df.sparkSession
    coded = encode_labels(df.filter(as_column(label).isNotNull()), label, "__y")
    split = train_test_split(coded, sample_id, test_size, seed, "__test")
    rows = []
    for embedding in embeddings:
        one = split.select("__y", "__test", as_column(embedding).alias("__v"))
        train = one.filter(~F.col("__test"))
        test = one.filter(F.col("__test"))
        train, test = robust_scale(train, test, vector="__v", name="__x")
        train, test = train.select("__y", "__x").persist(), test.select("__y", "__x").persist()

        def accuracy(name: str, train: DataFrame = train, test: DataFrame = test) -> float:
            predicted = fit_predict(models[name], train, test, "__x", "__y", "__p")
            hit = predicted.agg(F.avg((F.col("__y") == F.col("__p")).cast("double")).alias("a"))
            return hit.first()["a"]

        try:
            with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
                rows += [(embedding, *found) for found in zip(models, pool.map(accuracy, models), strict=True)]
        finally:
            train.unpersist()
            test.unpersist()
    return spark.createDataFrame(rows, "embedding string, classifier string, accuracy double")


def compare_classifiers(grid: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """The grid as a table, one row per vector column and one column per classifier."""
    names = list(models or classifiers())
    return accuracy_matrix(grid, names)


class BayesModel(NamedTuple):
    """Multinomial Naive Bayes as two tables.

    ``terms`` has (token, label, gain): what one occurrence of the token adds for the label, beyond what a token adds that
    its texts never had. ``classes`` has (label, prior, base): the share of its texts, and that lowest addition, as logarithms.
    ``tokens`` is the vocabulary of all training texts.
    """

    terms: DataFrame
    classes: DataFrame
    tokens: DataFrame
    stop_words: tuple[str, ...]


def fit_naive_bayes(
    train: DataFrame, text: str, label: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, smoothing: float = 1.0
) -> BayesModel:
    """Count the words of the labelled training texts; any number of classes, nothing on the driver but the size of the
    vocabulary."""
    stop = tuple(stop_words)
    known = train.filter(as_column(label).isNotNull()).select(as_column(label).alias("label"), words.tokens(text, stop).alias("w"))
    counts = stored(
        fn.unnest(known, F.col("w"), ["label"], "token").groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")), "word-counts"
    )
    tokens = stored(counts.select("token").distinct(), "vocabulary")
    size, texts = tokens.count(), known.count()
    sums = counts.groupBy("label").agg(F.sum("n").alias("words"))
    per_class = known.groupBy("label").agg(F.count(F.lit(1)).alias("texts")).join(sums, "label", "left")
    below = F.coalesce("words", F.lit(0)) + F.lit(smoothing * max(1, size))
    classes = per_class.select(
        "label", F.log(F.col("texts") / F.lit(max(1, texts))).alias("prior"), F.log(F.lit(smoothing) / below).alias("base")
    )
    gain = F.log((F.col("n") + smoothing) / F.lit(smoothing))
    return BayesModel(counts.select("token", "label", gain.alias("gain")), stored(classes, "classes"), tokens, stop)


def classify_naive_bayes(test: DataFrame, text: str, model: BayesModel, sample_id: str) -> DataFrame:
    """(sample_id, predicted, score) of each text: the most likely label, ties by label, and its log likelihood.

    Words that no training text has are left out. A text is joined to the classes that share a word with it. Of all the
    other classes only the best can win, and which one that is depends on the number of known words alone, so it
    is looked up by that number. Ids must be unique. Texts without known words get the most frequent label.
    """
    texts = test.select(as_column(sample_id).alias("sample_id"), words.tokens(text, model.stop_words).alias("w"))
    counted = fn.unnest(texts, F.col("w"), ["sample_id"], "token").groupBy("sample_id", "token").agg(F.count(F.lit(1)).alias("n"))
    known = stored(lookup_join(counted, model.tokens, ["token"], "left_semi"), "known-words")
    sizes = texts.select("sample_id").join(known.groupBy("sample_id").agg(F.sum("n").alias("words")), "sample_id", "left")
    sizes = stored(sizes.select("sample_id", F.coalesce("words", F.lit(0)).alias("words")), "text-sizes")
    met = lookup_join(known, model.terms, ["token"]).groupBy("sample_id", "label").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    base = F.col("prior") + F.col("words") * F.col("base")
    scored = lookup_join(met.join(sizes, "sample_id"), model.classes, ["label"]).select(
        "sample_id", "label", (base + F.col("gain")).alias("score")
    )
    # A class that has no more texts and no higher base than another is never best: few remain.
    ahead = Window.orderBy(F.desc("prior"), F.desc("base"), "label").rowsBetween(Window.unboundedPreceding, -1)
    edge = model.classes.withColumn("high", F.max("base").over(ahead)).filter("high IS NULL OR base > high").drop("high")
    rest = sizes.select("words").distinct().crossJoin(F.broadcast(edge)).select("words", "label", base.alias("score"))
    rest = rest.groupBy("words").agg(_best("score", "label").alias("b")).select("words", "b.label", (-F.col("b.s")).alias("score"))
    others = lookup_join(sizes, rest, ["words"]).select("sample_id", "label", "score")
    best = scored.unionByName(others).groupBy("sample_id").agg(_best("score", "label").alias("b"))
    return best.select("sample_id", F.col("b.label").alias("predicted"), (-F.col("b.s")).alias("score"))


def _best(score: str, label: str) -> Column:
    """Highest score; those that agree in twelve places count as equal, then the first label."""
    return F.min(F.struct((-F.round(F.col(score), 12)).alias("s"), F.col(label).alias("label")))


def naive_bayes(
    train: DataFrame,
    test: DataFrame,
    text: str,
    label: str,
    sample_id: str,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
    name: str = "predicted",
) -> DataFrame:
    """Fit word counts of the training texts, add the predicted label to the test texts. Ids must be unique."""
    found = classify_naive_bayes(test, text, fit_naive_bayes(train, text, label, stop_words), sample_id)
    return test.join(found.select(F.col("sample_id").alias(sample_id), F.col("predicted").alias(name)), sample_id, "left")


def class_centroids(examples: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean of the scaled example vectors of every class, scaled again: (label, centroid)."""
    unit = l2_normalize(examples, vector, "__unit")
    centres = mean_vector(unit, label, "__unit", "centroid")
    return l2_normalize(centres, "centroid")


def _class_blocks(centroids: DataFrame, label: str) -> Iterator[tuple[list, np.ndarray]]:
    """Labels in order and their centroids, in blocks of bounded size."""
    names, rows = [], []
    for row in centroids.select(as_column(label).alias("label"), "centroid").orderBy("label").toLocalIterator():
        names.append(row["label"])
        rows.append(row["centroid"])
        if len(rows) * len(rows[0]) >= CLASS_NUMBERS:
            yield names, np.array(rows, np.float64)
            names, rows = [], []
    if names:
        yield names, np.array(rows, np.float64)


def _products(column: pa.Array, classes: np.ndarray) -> np.ndarray:
    """Cosines of a column of vectors with unit rows; 0 for a vector without length. Rounded, so that ties are ties."""
    matrix = np.asarray(column.flatten(), np.float64).reshape(-1, classes.shape[1])
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
    return unit @ classes.T


def best_classes(tags: DataFrame, vector: str, centroids: DataFrame, label: str, name: str = "best") -> DataFrame:
    """Adds the (label, score) of the class whose mean is most like the tag's vector, ties by label.

    A matrix product per batch of tags and block of classes. Several blocks are taken one after the other in the same
    task, each with the best so far, so any number of classes takes no shuffle. Null vectors have no class.
    """
    kind = T.StructType().add("label", centroids.schema[label].dataType).add("score", "double")
    out, place = tags.withColumn(name, F.lit(None).cast(kind)), len(tags.columns)
    for names, classes in _class_blocks(centroids, label):
        out = out.mapInArrow(_better_class(names, classes, tags.columns.index(vector), place), out.schema)
    return out


def _better_class(names: list, classes: np.ndarray, vector: int, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TAG_ROWS):
                batch = whole.slice(at, TAG_ROWS)
                column = batch.column(vector)
                known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                best = batch.column(place).to_pylist()
                if len(known):
                    scores = _products(column.take(pa.array(known)), classes)
                    first = np.round(scores, 12).argmax(1)
                    for row, k, score in zip(known, first, scores[np.arange(len(known)), first], strict=True):
                        if best[row] is None or round(float(score), 12) > round(best[row]["score"], 12):
                            best[row] = {"label": names[k], "score": float(score)}
                columns = [*batch.columns[:place], pa.array(best, batch.column(place).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def tag_scores(tags: DataFrame, vector: str, centroids: DataFrame, label: str) -> DataFrame:
    """Adds ``scores``: for every class its label and the cosine with the tag's vector, in the order of the labels.

    Worked out as in :func:`best_classes`; for the best class alone that one holds far less.
    """
    kind = T.ArrayType(T.StructType().add("label", centroids.schema[label].dataType).add("score", "double"))
    out, place = tags.withColumn("scores", F.array().cast(kind)), len(tags.columns)
    for names, classes in _class_blocks(centroids, label):
        out = out.mapInArrow(_more_scores(names, classes, tags.columns.index(vector), place), out.schema)
    return out


def _more_scores(names: list, classes: np.ndarray, vector: int, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CLASS_NUMBERS // len(names))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                column, scores = batch.column(vector), batch.column(place).to_pylist()
                known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if len(known):
                    for row, found in zip(known, _products(column.take(pa.array(known)), classes).tolist(), strict=True):
                        scores[row] = scores[row] + [{"label": n, "score": x} for n, x in zip(names, found, strict=True)]
                columns = [*batch.columns[:place], pa.array(scores, batch.column(place).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def best_score(scores: str = "scores") -> Column:
    """The (label, score) with the highest score; ties by label."""
    # entries are in label order, so of equal scores the first entry is the right one
    ranked = F.transform(
        as_column(scores),
        lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("i"), s["label"].alias("label")),
    )
    best = F.array_max(ranked)
    return F.struct(best["label"].alias("label"), best["score"].alias("score"))


def score_batches(
    pending: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    columns: Sequence[str],
    schema: T.StructType = PREDICTION_SCHEMA,
    partitions: int | None = None,
) -> DataFrame:
    """Run a caller's batch scorer over pending prompts.

    ``scorer`` gets a pandas frame with ``columns`` and gives one with the columns of ``schema``.
    ``partitions`` limits how many batches are scored at once, as a rate limit.
    """
    chosen = pending.select(*[as_column(c) for c in columns])
    if partitions:
        chosen = chosen.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return chosen.mapInPandas(run, schema)
