"""Fitted models. Where a solver decides the numbers, the query says what must hold for them."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import CLUSTERS, ELBOW_MAX_K, SPLIT_SEED
from tagloom.functions.arrays import distance
from tagloom.operators import classify as cf
from tagloom.operators import cluster as cl
from tagloom.operators import kernels as kn
from tagloom.operators import labels as lb
from tagloom.operators import vectors as vc
from tagloom.queries.registry import (
    SQL_STOP_WORDS,
    SQL_TOKENS,
    STOP_WORDS,
    query,
    sql_uniform,
    table,
    texts,
)

SQL_IS_TEST = f"{sql_uniform(SPLIT_SEED, 'vec_id')} <= 0.25"
#: All rows with their class number and side, and that the classifier has learned.
SQL_JUDGED = f"""
    SELECT vec_id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS y, {SQL_IS_TEST} AS is_test, true AS in_range, true AS learned
    FROM embeddings
"""


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scaled training and test vectors with class numbers."""
    coded = lb.encode_labels(table(spark, sf, "embeddings"), "label", "y")
    split = lb.train_test_split(coded, "vec_id")
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    train, test = cf.robust_scale(train, test, vector="embedding", name="x")
    return train.select("vec_id", "y", "x"), test.select("vec_id", "y", "x")


def _judged(spark: SparkSession, sf: str, model) -> DataFrame:
    """All rows, whether the prediction is a class, and whether the classifier tells the rows it was fitted on more often
    right than their most frequent class would be. (Labels of the test table can't be told from its vectors.)"""
    train, test = _split(spark, sf)
    both = train.withColumn("is_test", F.lit(False)).union(test.withColumn("is_test", F.lit(True)))
    found = cf.fit_predict(model, train, both, "x", "y", "predicted").select("vec_id", "y", "is_test", "predicted")
    fitted = found.filter("NOT is_test")
    counts = fitted.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == F.col("predicted")).alias("right"))
    # one row
    limits = counts.agg(F.max("y").alias("last"), (F.sum("right") > F.max("n")).alias("learned"))
    in_range = F.col("predicted").between(0, F.col("last"))
    return found.join(F.broadcast(limits)).select("vec_id", "y", "is_test", in_range.alias("in_range"), "learned")


def _power(matrix: str, start: str) -> str:
    """SQL for the leading direction of a symmetric matrix (one row, a list of rows), by squaring it again and again."""
    return f"""
    {matrix}_powers AS (
        SELECT 0 AS step, m FROM {start} UNION ALL
        SELECT step + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / t)) FROM (
            SELECT step, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) AS t FROM (
                SELECT step, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS s
                FROM {matrix}_powers WHERE step < 40))
    ), {matrix}_row AS (
        SELECT m[i] AS r, m[i][i] AS d FROM {matrix}_powers, range(1, 65) t(i) WHERE step = 40 ORDER BY d DESC, i LIMIT 1
    ), {matrix} AS (SELECT list_transform(r, lambda x: x / sqrt(d)) AS v FROM {matrix}_row)"""


@query(f"""
    WITH RECURSIVE entries AS (
        SELECT vec_id, i, embedding[i]::DOUBLE - avg(embedding[i]::DOUBLE) OVER (PARTITION BY i) AS x
        FROM embeddings, range(1, 65) t(i)
    ), centred AS MATERIALIZED (SELECT vec_id, list(x ORDER BY i) AS v FROM entries GROUP BY vec_id),
    products AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS c FROM entries a JOIN entries b USING (vec_id) GROUP BY ALL),
    lines AS (SELECT i, list(c ORDER BY j) AS r FROM products GROUP BY i),
    whole AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM lines),
    {_power('first', 'whole')},
    less AS MATERIALIZED (
        SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - size * v[i] * v[j])) AS m FROM (
            SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS size FROM whole, first)
    ),
    {_power('second', 'less')},
    placed AS (
        SELECT vec_id, list_dot_product(c.v, f.v) AS x, list_dot_product(c.v, s.v) AS y FROM centred c, first f, second s
    )
    SELECT vec_id, round(x * sign(first_value(x) OVER (ORDER BY vec_id)), 4) AS x,
           round(y * sign(first_value(y) OVER (ORDER BY vec_id)), 4) AS y FROM placed
""")
def pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Both coordinates of every vector; the sign is free, so it is set by the vector of smallest id."""
    vectors = cl.pca_2d(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    placed = vectors.select("vec_id", F.get("pca", F.lit(0)).alias("x"), F.get("pca", F.lit(1)).alias("y"))
    first = placed.agg(*[F.signum(F.min_by(c, "vec_id")).alias(f"sign_{c}") for c in ("x", "y")])
    signed = placed.join(F.broadcast(first))
    return signed.select("vec_id", *[F.round(F.col(c) * F.col(f"sign_{c}"), 4).alias(c) for c in ("x", "y")])


def _near_own_mean(placed: DataFrame, vector: str, cluster: str) -> Column:
    """Whether no mean of another cluster is nearer to a vector than that of its own, but for what a fit leaves open."""
    means = vc.mean_vector(placed, cluster, vector, "mean").collect()  # one row per cluster
    spots = F.array(*[F.struct(F.lit(r[cluster]).alias("c"), F.lit([float(x) for x in r["mean"]]).alias("m")) for r in means])
    away = F.transform(spots, lambda s: F.struct(distance(vector, s["m"]).alias("d"), s["c"].alias("c")))
    own = F.get(F.filter(away, lambda a: a["c"] == F.col(cluster)), F.lit(0))["d"]
    return own <= F.array_min(F.transform(away, lambda a: a["d"])) + 0.01


@query(f"SELECT count(*) AS vectors, {CLUSTERS}::BIGINT AS clusters, true AS near_own_mean FROM embeddings")
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector lies in one of the clusters, the one whose mean is nearest to it."""
    placed = cl.kmeans(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    near = placed.select("cluster", _near_own_mean(placed, "embedding", "cluster").alias("near"))
    sizes = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.every("near").alias("near"))
    return sizes.agg(F.sum("n").alias("vectors"), F.count(F.lit(1)).alias("clusters"), F.every("near").alias("near_own_mean"))


@query("SELECT vec_id, true AS embedding_near, true AS half_near FROM embeddings")
def cluster_all_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of vectors, each scaled and clustered: each lies in the cluster whose mean is nearest."""
    vectors = table(spark, sf, "embeddings").withColumn("half", F.slice("embedding", 1, 32))
    placed = cl.cluster_all_methods(vectors.select("vec_id", "embedding", "half"), ["embedding", "half"])
    unit = vc.l2_normalize(vc.l2_normalize(placed, "embedding"), "half")
    near = [_near_own_mean(unit, m, f"{m}_cluster").alias(f"{m}_near") for m in ("embedding", "half")]
    return unit.select("vec_id", *near)


@query(f"""
    WITH entries AS (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
    total AS (SELECT sum(s) AS sse FROM (SELECT var_pop(x) * count(*) AS s FROM entries GROUP BY i))
    SELECT k::INTEGER AS k, CASE WHEN k = 1 THEN round(sse, 4) END AS sse, true AS falls
    FROM total, range(1, {ELBOW_MAX_K + 1}) t(k)
""")
def elbow(spark: SparkSession, sf: str) -> DataFrame:
    """Exact for one cluster; with more clusters less is left than with one, and more than nothing."""
    found = cl.elbow(table(spark, sf, "embeddings"), "embedding")
    whole = found.filter("k = 1").select(F.col("sse").alias("whole"))
    falls = (F.col("sse") > 0) & ((F.col("k") == 1) | (F.col("sse") < F.col("whole")))
    return found.join(F.broadcast(whole)).select("k", F.when(F.col("k") == 1, F.round("sse", 4)).alias("sse"), falls.alias("falls"))


@query(f"""
    WITH entries AS (
        SELECT (i - 1)::INTEGER AS pos, {SQL_IS_TEST} AS is_test, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)
    )
    SELECT pos, count(*) FILTER (NOT is_test) AS rows, true AS centred, true AS scaled FROM entries GROUP BY pos
""")
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    """After scaling, half of the training values of each entry lie below 0, and half between quartiles that are 1 apart."""
    train, _ = _split(spark, sf)
    entries = train.select(F.posexplode(vector_to_array("x")).alias("pos", "value"))
    quarters = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = entries.groupBy("pos").agg(F.count(F.lit(1)).alias("rows"), quarters.alias("q"))
    # the scaler's quantiles are exact to a thousandth of the rows, and it takes a value that occurs
    return found.select(
        "pos", "rows", (F.abs(F.get("q", F.lit(1))) < 0.05).alias("centred"),
        (F.abs(F.get("q", F.lit(2)) - F.get("q", F.lit(0)) - 1) < 0.05).alias("scaled"),
    )


@query(SQL_JUDGED)
def logistic_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, cf.classifiers()[cf.LOGISTIC_REGRESSION])


@query(SQL_JUDGED)
def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, cf.classifiers()[cf.RANDOM_FOREST])


@query(SQL_JUDGED)
def decision_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, cf.classifiers()[cf.DECISION_TREE])


@query(SQL_JUDGED)
def linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, cf.classifiers()[cf.SVM])


@query(SQL_JUDGED)
def kernel_svm(spark: SparkSession, sf: str) -> DataFrame:
    """The support vector machine with the RBF kernel."""
    return _judged(spark, sf, cf.classifiers(kernel="rbf")[cf.SVM])


@query(f"""
    SELECT {SQL_IS_TEST} AS is_test, round(1.0 / (64 * var_pop(x)), 6) AS gamma FROM (
        SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1
""")
def kernel_width(spark: SparkSession, sf: str) -> DataFrame:
    """The width of the kernel that follows from the vectors of each side of the split."""
    split = lb.train_test_split(table(spark, sf, "embeddings"), "vec_id")
    rows = [(side, round(kn.spread_gamma(split.filter(F.col("is_test") == side), "embedding"), 6)) for side in (False, True)]
    return spark.createDataFrame(rows, "is_test boolean, gamma double")


@query(f"""
    SELECT unnest(['embedding', 'half']) AS embedding, count(*) AS test_rows, true AS "Logistic_Regression",
           true AS "Support_Vector_Machine", true AS "Random_Forest", true AS "Decision_Tree"
    FROM embeddings WHERE {SQL_IS_TEST}
""")
def classifier_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every classifier on every kind of vector: whether its accuracy is a part of the test rows."""
    vectors = table(spark, sf, "embeddings").withColumn("half", F.slice("embedding", 1, 32))
    models = cf.classifiers()
    grid = cf.compare_classifiers(cf.classifier_grid(vectors, ["embedding", "half"], "label", "vec_id", models), list(models))
    rows = lb.train_test_split(vectors, "vec_id").agg(F.count_if("is_test").alias("test_rows"))
    right = {m: F.col(m) * F.col("test_rows") for m in models}
    shares = [(F.col(m).between(0, 1) & (F.abs(r - F.round(r)) < 1e-6)).alias(m) for m, r in right.items()]
    return grid.join(F.broadcast(rows)).select("embedding", "test_rows", *shares)


@query(f"""
    WITH cut AS (
        SELECT doc_id, lang, {sql_uniform(SPLIT_SEED, 'doc_id')} <= 0.25 AS is_test,
               list_filter({SQL_TOKENS}, lambda t: t NOT IN ({SQL_STOP_WORDS})) AS w FROM documents
    ), learned AS (SELECT lang, unnest(w) AS token FROM cut WHERE NOT is_test AND lang IS NOT NULL),
    counts AS (SELECT token, lang, count(*) AS n FROM learned GROUP BY ALL),
    size AS (SELECT count(DISTINCT token) AS v FROM counts),
    classes AS (
        SELECT lang, ln(count(*) / (SELECT count(*) FROM cut WHERE NOT is_test AND lang IS NOT NULL)) AS prior,
               ln(1.0 / (coalesce(sum(len(w)), 0) + (SELECT v FROM size))) AS base
        FROM cut WHERE NOT is_test AND lang IS NOT NULL GROUP BY lang
    ), asked AS (
        SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM cut WHERE is_test)
        WHERE token IN (SELECT token FROM counts) GROUP BY ALL
    ), sizes AS (SELECT doc_id, sum(tf) AS words FROM asked GROUP BY doc_id),
    met AS (SELECT doc_id, lang, sum(tf * ln(n + 1)) AS gain FROM asked JOIN counts USING (token) GROUP BY ALL),
    scored AS (
        SELECT d.doc_id, d.lang AS truth, c.lang, c.prior + coalesce(words, 0) * c.base + coalesce(gain, 0) AS score
        FROM cut d CROSS JOIN classes c LEFT JOIN sizes USING (doc_id) LEFT JOIN met m ON m.doc_id = d.doc_id AND m.lang = c.lang
        WHERE is_test
    )
    SELECT doc_id, truth AS lang, lang AS predicted FROM scored
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) = 1
""")
def naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """The language of a quarter of the documents, from the words of the others."""
    split = lb.train_test_split(texts(spark, sf), "doc_id")
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    predicted = cf.naive_bayes(train, test, "text", "lang", "doc_id", STOP_WORDS)
    return predicted.select("doc_id", "lang", "predicted")
