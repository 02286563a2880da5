"""Profiles, pivots, votes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import attributes as at
from tagloom.operators import cluster as cl
from tagloom.operators import evaluate as ev
from tagloom.operators import labels as lb
from tagloom.operators import vectors as vc
from tagloom.queries.registry import query, table

# A rule that guesses a text's language from a frequent short word.
RULES = {"en": " the ", "fr": " le ", "de": " der "}


def guess_language(order: list[str]):
    guess = F
    for lang in order:
        guess = guess.when(F.contains(F.lower("text"), F.lit(RULES[lang])), lang)
    return guess.otherwise("es")


def sql_guess(order: list[str]) -> str:
    cases = " ".join(f"WHEN contains(lower(text), '{RULES[lang]}') THEN '{lang}'" for lang in order)
    return f"CASE {cases} ELSE 'es' END"


@query("""
    SELECT key AS field, min(event_id::VARCHAR) AS first_seen
    FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key
""")
def field_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the JSON properties as attribute names."""
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("sample_id"),
        F.transform(
            F.map_entries(F.from_json("props", "map<string,string>")),
            lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")),
        ).alias("attributes"),
    )
    return at.field_dictionary(at.long_attributes(events))


@query("""
    WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag
            ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem
    )
    SELECT l_orderkey AS sample_id, max(l_quantity) FILTER (l_returnflag = 'A' AND r = 1) AS A,
           max(l_quantity) FILTER (l_returnflag = 'R' AND r = 1) AS R
    FROM ranked GROUP BY l_orderkey
""")
def pivot_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Return flag as field; the last line of an order counts."""
    last = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    long = table(spark, sf, "lineitem").withColumn("pos", last)
    return at.pivot_attributes(long, ["A", "R"], "l_orderkey", "l_returnflag", "l_quantity", "pos")


@query("SELECT doc_id::VARCHAR AS sample_id, lang, source FROM documents")
def wide_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """The same from records that carry their attributes, without a shuffle; a repeated field is replaced."""
    def pair(name: str, value):
        return F.struct(F.lit(name).alias("field"), value.alias("value"))

    records = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.array(
            pair("lang", F.lit("first")), pair("source", F.col("source")), pair("lang", F.col("lang"))
        ).alias("attributes"),
    )
    return at.wide_attributes(records, ["lang", "source"])


@query("SELECT DISTINCT lang FROM documents")
def class_values(spark: SparkSession, sf: str) -> DataFrame:
    return lb.class_values(table(spark, sf, "documents"), "lang")


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("text").distinct().select(F.md5("text").alias("digest"))


@query("SELECT label AS cluster, (vec_id % 3)::BIGINT AS part, count(*) AS n FROM embeddings GROUP BY ALL")
def cluster_composition(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"), (F.col("vec_id") % 3).alias("part")
    )
    return cl.cluster_composition(vectors, "cluster", "part")


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"))
    return cl.cluster_sizes(vectors)


@query("SELECT DISTINCT lang, source AS value FROM documents "
       "UNION SELECT DISTINCT lang, n_chars::VARCHAR FROM documents")
def tags_by_class(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return ev.tags_by_class(at.to_long(docs, "doc_id", ["source", "n_chars"], keep=["lang"]), "lang")


SQL_VOTES = """
    SELECT user_id, predicted, votes FROM (
        SELECT user_id, event_type AS predicted, count(*) AS votes,
               row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
        FROM events WHERE value >= {least} GROUP BY user_id, event_type) WHERE r = 1
"""


@query(f"""
    WITH votes AS ({SQL_VOTES.format(least=150)})
    SELECT DISTINCT e.user_id, coalesce(predicted, 'Unknown') AS predicted, coalesce(votes, 0) AS votes
    FROM events e LEFT JOIN votes USING (user_id)
""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Only events of at least 150 vote, so some users have no vote."""
    events = table(spark, sf, "events")
    tags = events.filter("value >= 150").select("user_id", F.col("event_type").alias("predicted"))
    return ev.majority_vote(tags, events.select("user_id"), "user_id")


SQL_LAST_TYPE = """
    SELECT user_id, event_type AS truth FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
"""


@query(f"""
    WITH votes AS ({SQL_VOTES.format(least=0)}), last AS ({SQL_LAST_TYPE})
    SELECT sum((predicted = truth)::INT)::BIGINT AS passed, count(*) AS total, 0::BIGINT AS unmatched,
           round_even(sum((predicted = truth)::INT) / count(*) * 100, 0) AS percent
    FROM votes JOIN last USING (user_id)
""")
def pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Votes against the type of the user's last event."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    truth = lb.last_wins(events, "user_id", "event_id").select(
        "user_id", F.col("event_type").alias("label")
    )
    votes = ev.majority_vote(events, None, "user_id", "event_type")
    return ev.pass_rate(ev.compare_predictions(votes, truth, "user_id"))


@query(f"""
    WITH pairs AS (SELECT lang AS t, {sql_guess(["en", "fr", "de"])} AS p FROM documents),
    classes AS (SELECT DISTINCT t AS class FROM pairs UNION SELECT DISTINCT p FROM pairs),
    counted AS (
        SELECT class, (SELECT count(*) FROM pairs WHERE t = class) AS support,
               (SELECT count(*) FROM pairs WHERE p = class) AS chosen,
               (SELECT count(*) FROM pairs WHERE t = class AND p = class) AS hit
        FROM classes
    ), rates AS (
        SELECT *, CASE WHEN chosen > 0 THEN hit / chosen ELSE 0 END AS pr,
               CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM counted
    ), scored AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM rates)
    SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, support FROM scored
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
        round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM scored
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(support)::BIGINT FROM scored
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
        round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM scored
""")
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("guess", guess_language(["en", "fr", "de"]))
    report = ev.classification_report(docs, "lang", "guess")
    return report.select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(f"""
    SELECT source AS embedding, round(avg((lang = {sql_guess(["en", "fr", "de"])})::INT), 6) AS rule_a,
           round(avg((lang = {sql_guess(["de", "fr", "en"])})::INT), 6) AS rule_b
    FROM documents GROUP BY source
""")
def accuracy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Two orders of the same rules as classifiers, sources as vector methods."""
    docs = table(spark, sf, "documents")
    hits = docs.select(
        F.col("source").alias("embedding"),
        (F.col("lang") == guess_language(["en", "fr", "de"])).cast("int").alias("rule_a"),
        (F.col("lang") == guess_language(["de", "fr", "en"])).cast("int").alias("rule_b"),
    )
    grid = (
        hits.unpivot("embedding", ["rule_a", "rule_b"], "classifier", "hit")
        .groupBy("embedding", "classifier")
        .agg(F.round(F.avg("hit"), 6).alias("accuracy"))
    )
    return ev.accuracy_matrix(grid, ["rule_a", "rule_b"])


@query("SELECT 'embedding' AS name, max(len(embedding))::INTEGER AS dimension FROM embeddings "
       "UNION ALL SELECT 'first_half', max(len(embedding[1:32]))::INTEGER FROM embeddings")
def vector_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("embedding", F.slice("embedding", 1, 32).alias("first_half"))
    return vc.vector_dimensions(vectors, ["embedding", "first_half"])


@query("SELECT label, (i - 1)::INTEGER AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean "
       "FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    means = vc.mean_vector(table(spark, sf, "embeddings"), "label", "embedding", "m")
    return means.select("label", F.posexplode("m").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


SQL_SSE = """
    WITH entries AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, {last}) t(i)),
    centred AS (SELECT label, vec_id, x - avg(x) OVER (PARTITION BY label, i) AS g FROM entries)
    SELECT label AS cluster, count(DISTINCT vec_id) AS n, round(sum(g * g), 5) AS sse FROM centred GROUP BY label
"""


@query(SQL_SSE.format(last=65))
def within_cluster_sse(spark: SparkSession, sf: str) -> DataFrame:
    found = cl.cluster_sse(table(spark, sf, "embeddings"), "embedding", "label")
    return found.withColumn("sse", F.round("sse", 5))


@query(SQL_SSE.format(last=3))
def within_cluster_sse_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Over the first two coordinates only."""
    found = cl.cluster_sse(table(spark, sf, "embeddings"), "embedding", "label", dimensions=2)
    return found.withColumn("sse", F.round("sse", 5))


@query("SELECT 'documents' AS table, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels")
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return at.row_counts(documents=table(spark, sf, "documents"), labels=table(spark, sf, "labels"))


@query(f"""
    SELECT outcome, count(*) AS n FROM (
        SELECT CASE WHEN lang = {sql_guess(["en", "fr", "de"])} THEN 'pass'
                    WHEN {sql_guess(["en", "fr", "de"])} = 'es' THEN 'fail' ELSE 'differs' END AS outcome
        FROM documents) GROUP BY outcome
""")
def result_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement, an answer outside the list (here: es), or another difference."""
    docs = table(spark, sf, "documents")
    predictions = docs.select("doc_id", guess_language(["en", "fr", "de"]).alias("predicted"))
    truth = docs.select("doc_id", F.col("lang").alias("label"))
    compared = ev.compare_predictions(predictions, truth, "doc_id")
    return ev.result_outcomes(ev.outcome(compared, F.col("predicted") != "es"), "outcome")


@query("SELECT DISTINCT lang AS value FROM documents UNION SELECT DISTINCT source FROM documents")
def append_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of several columns put together, then made distinct."""
    docs = table(spark, sf, "documents")
    return at.to_long(docs, "doc_id", ["lang", "source"]).select("value").distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").select("doc_id").distinct()
    return lb.missing_records(wanted, table(spark, sf, "labels"), "doc_id")
