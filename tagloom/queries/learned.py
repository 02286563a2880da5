"""Indexes, word vectors and taggers that are learned from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.functions.arrays import unnest
from tagloom.operators import labels as lb
from tagloom.operators import neighbours as nb
from tagloom.operators import tagger as tg
from tagloom.operators import vectors as vc
from tagloom.operators import wordvectors as wv
from tagloom.operators.joins import lookup_join
from tagloom.queries.joins import SQL_COSINE
from tagloom.queries.registry import SQL_STOP_WORDS, SQL_TOKENS, STOP_WORDS, query, table, texts
from tagloom.session import stored

#: Added to an id, and to the first entry of its vector.
PLANTED, MOVED = 10_000_000, 0.01
MIN_COUNT, WINDOW = 20, 2


@query(f"""
    WITH planted AS (
        SELECT vec_id + {PLANTED} AS query_id, list_prepend(embedding[1]::DOUBLE + {MOVED}, embedding[2:]::DOUBLE[]) AS v FROM embeddings
    ), scored AS (
        SELECT p.query_id, e.vec_id AS vector_id, {SQL_COSINE.format(a='p.v', b='e.embedding::DOUBLE[]')} AS s
        FROM planted p CROSS JOIN embeddings e
    )
    SELECT query_id, 1::INTEGER AS rank, vector_id, round(s, 6) AS similarity FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) = 1
""")
def approximate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector, moved a little, finds the vector it was in the index of cells."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = F.transform("v", lambda x, i: F.when(i == 0, x + MOVED).otherwise(x))
    queries = vectors.select((F.col("vec_id") + PLANTED).alias("query_id"), moved.alias("query_vector"))
    index = nb.build_index(vectors, "vec_id", "v")
    found = nb.search_index(index, queries, 1, nb.probes_for(index, queries, 1, recall=1.0))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT count(*) AS queries, true AS enough, true AS fewer_cells FROM embeddings")
def neighbour_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of the three vectors most like each vector, nine in ten at least are found without looking into every cell."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = nb.build_index(vectors, "vec_id", "embedding")
    probes = nb.probes_for(index, queries, 3, exclude_same_id=True)
    found = nb.search_index(index, queries, 3, probes, exclude_same_id=True)
    exact = vc.nearest_neighbours(vectors, queries, 3, "vec_id", "embedding", exclude_same_id=True)
    fewer = F.lit(probes < len(index.centres))
    return nb.recall_of(found, exact).select("queries", (F.col("recall") >= 0.9).alias("enough"), fewer.alias("fewer_cells"))


SQL_NEIGHBOURS = f"""
    words AS (
        SELECT list_filter({SQL_TOKENS}, lambda t: t NOT IN ({SQL_STOP_WORDS})) AS w FROM documents
    ), frequent AS (
        SELECT token FROM (SELECT unnest(w) AS token FROM words) GROUP BY token HAVING count(*) >= {MIN_COUNT}
    ), pairs AS (
        SELECT unnest(list_zip(w[1 : len(w) - g], w[1 + g : len(w)])) AS p FROM words, range(1, {WINDOW + 1}) t(g) WHERE len(w) > g
    ), ordered AS (SELECT p[1] AS token, p[2] AS context FROM pairs UNION ALL SELECT p[2], p[1] FROM pairs),
    neighbours AS (
        SELECT token, context, count(*) AS n FROM ordered
        WHERE token IN (SELECT token FROM frequent) AND context IN (SELECT token FROM frequent) GROUP BY ALL
    )
"""
SQL_ASSOCIATION = f"""
    {SQL_NEIGHBOURS}, totals AS (SELECT token, sum(n)::DOUBLE AS n, pow(sum(n)::DOUBLE, 0.75) AS s FROM neighbours GROUP BY token),
    shares AS (SELECT token, (ln(n / sum(n) OVER ()) + ln(s / sum(s) OVER ())) / 2 AS share FROM totals),
    association AS (
        SELECT n.token, n.context, ln(n.n / (SELECT sum(n) FROM totals)) - a.share - b.share AS weight
        FROM neighbours n JOIN shares a ON a.token = n.token JOIN shares b ON b.token = n.context
    )
"""


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return wv.neighbour_counts(texts(spark, sf), "text", WINDOW, MIN_COUNT, STOP_WORDS)


@query(f"WITH {SQL_NEIGHBOURS} SELECT * FROM neighbours")
def neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often frequent words stand near each other."""
    return _neighbours(spark, sf)


@query(f"WITH {SQL_ASSOCIATION} SELECT token, context, round(weight, 6) AS weight FROM association WHERE round(weight, 6) > 0")
def word_association(spark: SparkSession, sf: str) -> DataFrame:
    """Pointwise mutual information of words that stand near each other."""
    found = wv.association(_neighbours(spark, sf)).withColumn("weight", F.round("weight", 6))
    return found.filter("weight > 0")


@query(f"""
    WITH {SQL_ASSOCIATION}
    SELECT DISTINCT token, 50::INTEGER AS dimension, true AS near_itself FROM association WHERE weight > 0
""")
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all frequent words, learned from the texts; no word is nearer to another than to itself."""
    vectors = wv.train_word_vectors(texts(spark, sf), "text", 50, WINDOW, MIN_COUNT, STOP_WORDS)
    length = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    return vectors.select("token", F.size("vector").alias("dimension"), (length >= 0).alias("near_itself"))


@query(f"""
    WITH cut AS (SELECT doc_id, unnest({SQL_TOKENS}) AS token FROM documents)
    SELECT count(DISTINCT doc_id) AS texts, true AS mostly_right, true AS mostly_found FROM cut WHERE token LIKE '%tion'
""")
def learned_tagger(spark: SparkSession, sf: str) -> DataFrame:
    """Words that end in -tion are the entities. Those of three quarters of the documents are listed and learned from; are the
    other ones found too, and is little else taken for one?"""
    docs = texts(spark, sf)
    wanted = F.col("term").endswith("tion")
    words = unnest(lb.train_test_split(docs, "doc_id"), fn.tokens("text"), ["doc_id", "is_test"], "term").filter(wanted)
    listed = stored(words.filter("NOT is_test").select("term").distinct().withColumn("label", F.lit("TION")), "terms")
    learn_from = lb.train_test_split(docs, "doc_id").filter("NOT is_test")
    tagger = tg.learn(learn_from, "doc_id", "text", listed, passes=5)
    found = stored(tg.tag_learned(docs, "doc_id", "text", tagger), "mentions")
    told = found.agg(F.count(F.lit(1)).alias("told"), F.count_if(wanted).alias("right"))
    fresh = lookup_join(found.filter(wanted), listed.select("term"), ["term"], "left_anti").agg(F.count(F.lit(1)).alias("fresh"))
    there = lookup_join(words, listed.select("term"), ["term"], "left_anti").agg(F.count(F.lit(1)).alias("there"))
    # one row of each
    counts = words.agg(F.count_distinct("doc_id").alias("texts")).join(there).join(told).join(fresh)
    return counts.select(
        "texts", (F.col("right") > 0.7 * F.col("told")).alias("mostly_right"), (F.col("fresh") > 0.7 * F.col("there")).alias("mostly_found")
    )
