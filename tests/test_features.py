import math
import random
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import classify, cluster, sieve, tfidf, vectors

TEXTS = [
    "chicken breast raw chicken",
    "raw chicken breast meat",
    "human blood culture",
    "human stool",
    "blood culture of a human patient",
    "river water and soil",
    "soil near the river",
    "chicken and the egg",
    "",
    "the the the",
]
STOP = ("the", "and", "of", "a", "near")


def brute_tfidf(texts, stop, limit, low, high, min_df, max_df):
    docs = []
    for t in texts:
        w = [x for x in re.findall(r"\w{2,}", t.lower()) if x not in stop]
        docs.append(Counter(" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)))
    tf, df = Counter(), Counter()
    for d in docs:
        tf.update(d)
        df.update(d.keys())
    n = len(texts)
    usable = [t for t in tf if min_df <= df[t] <= max_df * n]
    terms = sorted(sorted(usable, key=lambda t: (-tf[t], t))[:limit])
    out = {}
    for i, d in enumerate(docs):
        raw = {t: d[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in terms if d[t]}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, t): round(x / length, 9) for t, x in raw.items()})
    return terms, out


@pytest.mark.parametrize("limit", [3, 8, 300])
@pytest.mark.parametrize("grams", [(1, 3), (1, 1), (2, 3)])
@pytest.mark.parametrize("bits", [1 << 18, 64])
def test_tfidf_against_brute_force(spark, monkeypatch, limit, grams, bits):
    monkeypatch.setattr(sieve, "BITS", bits)  # with few bits nearly every word passes
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    model = tfidf.fit_tfidf(df, "t", STOP, limit, grams)
    terms, weights = brute_tfidf(TEXTS, STOP, limit, *grams, 2, 0.7)
    assert model.terms == terms
    rows = model.weights(df, "id", "t").collect()
    assert {(r.sample_id, r.term): round(r.weight, 9) for r in rows} == weights
    assert model.transform(df, "t").count() == len(TEXTS)


def test_empty_vocabulary_is_an_error(spark):
    df = spark.createDataFrame([(1, "one two")], "id int, t string")
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(df, "t").transform(df, "t")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    # a third of the rows are copies of one vector
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(999, [0.0] * 6)]
    return spark.createDataFrame(rows, "id int, v array<double>").repartition(7)


@pytest.mark.parametrize("block", [4096, 40])
@pytest.mark.parametrize("own", [True, False])
def test_neighbours_against_brute_force(points, block, own):
    rows = points.collect()
    ids = [r.id for r in rows]
    m = np.array([r.v for r in rows])
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)
    sims = np.round(u @ u.T, 9)
    queries = points.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    got = vectors.nearest_neighbours(points, queries, 4, "id", "v", query_rows=block, exclude_same_id=not own)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, round(r.similarity, 9)))
    for i, q in enumerate(ids):
        want = sorted((-sims[i][j] for j in range(len(ids)) if own or ids[j] != q))[:4]
        assert [s for _, s in sorted(found[q])] == [-w for w in want]


def test_means_and_dimensions(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 3), ("b", [0.0, 1.0], 1)], "g string, v array<double>, w int")
    assert {r.g: r.vector for r in vectors.mean_vector(df, "g", "v").collect()} == {"a": [2.0, 3.0], "b": [0.0, 1.0]}
    assert {r.g: r.vector for r in vectors.mean_vector(df, "g", "v", weight="w").collect()}["a"] == [2.5, 3.5]
    assert [tuple(r) for r in vectors.vector_dimensions(df, ["v"]).collect()] == [("v", 2)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_document_embedding(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(vectors, "fits", lambda *a: False)
    table = spark.createDataFrame([("pig", [3.0, 4.0]), ("cow", [0.0, 2.0])], "token string, vector array<double>")
    docs = spark.createDataFrame([(1, "pig pig cow yak"), (2, "yak"), (3, "")], "id int, t string")

    def run(**how):
        return {r.sample_id: r.vector for r in vectors.document_embedding(docs, "id", "t", table, 2, **how).collect()}

    assert run()[1] == pytest.approx([1.2 / 3, 2.6 / 3])
    assert run()[2] == run()[3] == [0.0, 0.0]
    plain = run(normalize_tokens=False, count_unknown=True)
    assert plain[1] == pytest.approx([6 / 4, 10 / 4])


def test_pair_distance(spark, points):
    pairs = spark.createDataFrame([(0, 1), (0, 200), (1, 5000)], "a int, b int")
    rows = {(r.a, r.b): r for r in vectors.pair_distance(pairs, points, "id", "v").collect()}
    assert set(rows) == {(0, 1), (0, 200)}
    assert rows[(0, 200)].distance == 0 and rows[(0, 200)].similarity == pytest.approx(1)


@pytest.fixture(scope="module")
def blobs(spark):
    """Three well separated groups of points, one of them large."""
    rng = np.random.default_rng(1)
    centres = {"x": [9, 0, 0], "y": [0, 9, 0], "z": [0, 0, 9]}
    rows = []
    for label, n in (("x", 100), ("y", 40), ("z", 40)):
        rows += [(len(rows) + i, label, (rng.normal(size=3) * 0.3 + centres[label]).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, label string, v array<double>").persist()


def test_clusters_find_groups(blobs):
    placed = cluster.kmeans(blobs, "v", k=3)
    rows = cluster.cluster_composition(placed, "cluster", "label").collect()
    assert sorted(r.n for r in rows) == [40, 40, 100]
    assert sum(r.n for r in cluster.cluster_sizes(placed).collect()) == 180
    again = {r.id: r.cluster for r in cluster.kmeans(blobs, "v", k=3).collect()}
    assert again == {r.id: r.cluster for r in placed.collect()}


def test_all_methods_and_elbow(blobs):
    out = cluster.cluster_all_methods(blobs.withColumn("w", F.slice("v", 1, 2)), ["v", "w"], k=3)
    assert {"v_cluster", "v_pca", "w_cluster", "w_pca"} <= set(out.columns)
    assert out.count() == 180
    sse = {r.k: r.sse for r in cluster.elbow(blobs, "v", max_k=4).collect()}
    assert list(sse) == [1, 2, 3, 4] and sse[1] > sse[2] > sse[3]
    assert sse[2] > 10 * sse[3]
    flat = {r.k: r.sse for r in cluster.elbow(blobs, "v", max_k=3, dimensions=2).collect()}
    assert all(flat[k] <= sse[k] + 1e-6 for k in flat)


def test_sse_and_pca_against_numpy(blobs):
    rows = blobs.collect()
    m = np.array([r.v for r in rows])
    got = {r.cluster: r.sse for r in cluster.cluster_sse(blobs, "v", "label").collect()}
    for label in "xyz":
        part = m[[r.label == label for r in rows]]
        assert got[label] == pytest.approx(((part - part.mean(0)) ** 2).sum())
    _, _, axes = np.linalg.svd(m - m.mean(0), full_matrices=False)
    want = (m - m.mean(0)) @ axes[:2].T
    found = {r.id: r.pca for r in cluster.pca_2d(blobs, "v").collect()}
    have = np.array([found[r.id] for r in rows])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-6)


def test_grid_beats_the_majority_class(blobs):
    models = classify.classifiers(trees=10, max_depth=5)
    grid = classify.classifier_grid(blobs, ["v"], "label", "id", models)
    row = classify.compare_classifiers(grid).first()
    assert all(row[name] > 0.9 for name in models)


def test_robust_scale_keeps_features_without_range(spark):
    rows = [(i, [float(i), 7.0 if i < 95 else 9.0]) for i in range(100)]
    train = spark.createDataFrame(rows, "id int, v array<double>")
    (scaled,) = classify.robust_scale(train, vector="v", name="x")
    values = {r.id: r.x.toArray() for r in scaled.collect()}
    assert values[99][1] == 2.0 and values[0][1] == 0.0
    assert values[75][0] - values[25][0] == pytest.approx(1, abs=0.05)


def by_hand_bayes(train, test):
    """Multinomial Naive Bayes with every word of every class."""
    cut = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    known = [(cut(t), lab) for _, t, lab in train if lab is not None]
    vocabulary = {w for ws, _ in known for w in ws}
    labels = sorted({lab for _, lab in known})
    out = {}
    for i, t, _ in test:
        scores = []
        for lab in labels:
            own = Counter(w for ws, x in known if x == lab for w in ws)
            score = math.log(sum(x == lab for _, x in known) / len(known))
            score += sum(math.log((own[w] + 1) / (sum(own.values()) + len(vocabulary))) for w in cut(t) if w in vocabulary)
            scores.append((-round(score, 9), lab))
        out[i] = min(scores)[1]
    return out


def test_naive_bayes_against_every_class(spark):
    rng = random.Random(4)
    def text(k):
        return " ".join(rng.choice([f"own{k}x{rng.randrange(4)}", f"all{rng.randrange(9)}", "new" + str(rng.randrange(99))]) for _ in range(rng.randrange(7)))
    train = [(i, text(i % 40), f"class{min(i % 40, rng.randrange(40)):02d}") for i in range(300)] + [(900, "own1x1", None), (901, None, "class07"), (902, "", "rare")]
    test = [(1000 + i, text(rng.randrange(50)), None) for i in range(150)] + [(5000, None, None), (5001, "", None), (5002, "unheard of", None)]
    frames = [spark.createDataFrame(rows, "id int, t string, l string").repartition(3) for rows in (train, test)]
    found = classify.naive_bayes(*frames, "t", "l", "id", stop_words=())
    assert found.columns == ["id", "t", "l", "predicted"]
    assert {r.id: r.predicted for r in found.collect()} == by_hand_bayes(train, test)
    # judged again on texts that come later
    model = classify.fit_naive_bayes(frames[0], "t", "l", ())
    later = spark.createDataFrame([(1, "own3x1 own3x2 own3x0"), (2, "own5x1 own5x2 own5x3")], "id int, t string")
    assert len(classify.classify_naive_bayes(later, "t", model, "id").collect()) == 2
    assert classify.classify_naive_bayes(later.limit(0), "t", model, "id").count() == 0


def test_twenty_thousand_classes(spark, monkeypatch):
    """More classes than fit in one block: the best one is found all the same."""
    monkeypatch.setattr(classify, "CLASS_NUMBERS", 60_000)
    rng = np.random.default_rng(0)
    means = rng.normal(size=(20_000, 8))
    centroids = vectors.l2_normalize(
        spark.createDataFrame([(f"c{i:05d}", m.tolist()) for i, m in enumerate(means)], "label string, centroid array<double>"), "centroid"
    )
    tags = spark.createDataFrame([(i, (means[i * 97] * 3).tolist()) for i in range(200)] + [(999, None)], "id int, v array<double>")
    best = {r.id: r.best for r in classify.best_classes(tags, "v", centroids, "label").collect()}
    assert best.pop(999) is None
    assert {i: b.label for i, b in best.items()} == {i: f"c{i * 97:05d}" for i in range(200)}
    assert all(b.score == pytest.approx(1) for b in best.values())


def test_best_class_and_all_scores(spark):
    centroids = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "label string, centroid array<double>")
    tags = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0]), (4, None)], "id int, v array<double>")
    best = {r.id: r.best for r in classify.best_classes(tags, "v", centroids, "label").collect()}
    assert {i: b and (b.label, b.score) for i, b in best.items()} == {1: ("a", 1.0), 2: ("c", 1.0), 3: ("a", 0.0), 4: None}
    scores = {r.id: [(s.label, s.score) for s in r.scores] for r in classify.tag_scores(tags, "v", centroids, "label").collect()}
    assert scores[1] == [("a", 1.0), ("b", 1.0), ("c", 0.0)] and scores[4] == []
    assert classify.best_classes(tags, "v", centroids.limit(0), "label").filter("best IS NOT NULL").count() == 0


def test_best_score_takes_the_first_of_equals(spark):
    centroids = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "label string, centroid array<double>")
    tags = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    best = classify.tag_scores(tags, "v", centroids, "label").select("id", classify.best_score().alias("b"))
    assert {r.id: (r.b.label, r.b.score) for r in best.collect()} == {1: ("a", 1.0), 2: ("c", 1.0), 3: ("a", 0.0)}


def test_score_batches_with_a_callers_model(spark):
    pending = spark.createDataFrame([(str(i), "x" * i) for i in range(20)], "sample_id string, prompt string")

    def scorer(batch):
        return batch.assign(model="m", choices="Human", tokens=batch["prompt"].str.len())[
            ["sample_id", "model", "choices", "tokens", "prompt"]
        ]

    scored = classify.score_batches(pending, scorer, ["sample_id", "prompt"], partitions=2)
    assert scored.rdd.getNumPartitions() == 2
    assert {(r.sample_id, r.tokens) for r in scored.collect()} == {(str(i), i) for i in range(20)}


def test_fits_run_beside_each_other(blobs, monkeypatch):
    """The fits of several k wait for each other here, which they can only do at the same time; the results are Spark's."""
    together = threading.Barrier(3, timeout=60)

    def waiting(make=cluster.KMeans, **how):
        together.wait()
        return make(**how)

    monkeypatch.setattr(cluster, "KMeans", waiting)
    sse = {r.k: r.sse for r in cluster.elbow(blobs, "v", max_k=4).collect()}
    monkeypatch.undo()
    want = cluster.KMeans(k=3, seed=cluster.CLUSTER_SEED, initMode="k-means||", maxIter=300)
    fitted = want.fit(blobs.select(cluster.as_ml_vector("v").alias("features")))
    assert list(sse) == [1, 2, 3, 4] and sse[3] == pytest.approx(fitted.summary.trainingCost)


def test_a_pass_takes_a_step_of_every_k(spark, monkeypatch):
    """Spark's fits see drawn vectors only, the steps of all k share their passes and are Lloyd's, and what is left is as with Spark's fits."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4)) + [1e4, 0, 0, 0]
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(3).persist()
    passes, step, starts, settled = [], cluster._step, {}, cluster._settled
    monkeypatch.setattr(cluster, "_step", lambda *a: passes.append(sorted(a[1])) or step(*a))
    monkeypatch.setattr(cluster, "_settled", lambda *a: starts.update(a[1]) or settled(*a))
    sse = {r.k: r.sse for r in cluster.elbow(points, "v", max_k=5).collect()}
    flat = {r.k: r.sse for r in cluster.elbow(points, "v", max_k=5, dimensions=2).collect()}
    assert [2, 3, 4, 5] in passes
    ready = points.select(cluster.as_ml_vector("v").alias("features"))
    for k in range(2, 6):
        centres = starts[k] + x.mean(0)
        for _ in range(300):
            own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            left, before = ((x - centres[own]) ** 2).sum(), centres
            centres = np.array([x[own == j].mean(0) for j in range(k)])
            if ((centres - before) ** 2).sum(1).max() <= 1e-8:
                break
        assert sse[k] == pytest.approx(left, rel=1e-6)
        assert flat[k] == pytest.approx(((x - centres[own])[:, :2] ** 2).sum(), rel=1e-6)
        fitted = cluster.KMeans(k=k, seed=cluster.CLUSTER_SEED, initMode="k-means||", maxIter=300).fit(ready)
        assert sse[k] < 1.1 * fitted.summary.trainingCost


def test_elbow_of_alike_vectors(spark):
    """Fewer different vectors than clusters: nothing is left."""
    few = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], "id int, v array<double>")
    sse = {r.k: r.sse for r in cluster.elbow(few, "v", max_k=4).collect()}
    assert sse == {1: pytest.approx(10), **{k: pytest.approx(0, abs=1e-9) for k in (2, 3, 4)}}
    same = spark.createDataFrame([(i, [3.0]) for i in range(5)], "id int, v array<double>")
    assert [r.sse for r in cluster.elbow(same, "v", max_k=3).collect()] == [0, 0, 0]


def test_a_task_compares_few_vectors_at_once(points, monkeypatch):
    """Scores of a step are bounded, whatever the size of a batch; ties go to the smaller id as before."""
    queries = points.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    want = [tuple(r)[:3] for r in vectors.nearest_neighbours(points, queries, 4, "id", "v").orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(vectors, "STEP_ROWS", 3)
    got = [tuple(r)[:3] for r in vectors.nearest_neighbours(points, queries, 4, "id", "v").orderBy("query_id", "rank").collect()]
    assert got == want
