"""Whole workflows on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import CLUSTERS
from tagloom.functions.arrays import norm
from tagloom.functions.values import strip
from tagloom.operators import evaluate as ev
from tagloom.plans import attribute_table, feature_clusters, few_shot_tagger, prompt_agreement
from tagloom.plans import unlabelled_clusters as uc
from tagloom.queries.registry import (
    SQL_TOKENS,
    STOP_WORDS,
    accession,
    query,
    sql_hash,
    table,
    texts,
)
from tagloom.queries.sources import _record
from tagloom.session import scratch_path
from tagloom.sources import readers, writers


@query("SELECT 'SAMN' || lpad(p_partkey::VARCHAR, 8, '0') AS sample_id, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def attribute_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as record documents, written, read, parsed once and made wide."""
    path = scratch_path(spark, "documents")
    raw = table(spark, sf, "part").select(
        accession("p_partkey").alias("sample_id"),
        _record(
            accession("p_partkey"),
            p_name=F.col("p_name"), p_brand=F.col("p_brand"), p_size=F.col("p_size"),
        ).alias("raw"),
    )
    writers.write_raw_records(raw, path)
    tables = attribute_table.build(
        readers.read_records(spark, path, one_per_file=False), scratch_path(spark, "parsed")
    )
    return tables.wide(["p_name", "p_brand", "p_size"])


def _labels_and_attributes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("quality").cast("string").alias("source_type"),
        F.col("toxic").cast("string").alias("source_niche"),
    )
    attributes = texts(spark, sf).select(
        F.col("doc_id").cast("string").alias("sample_id"), "lang", "source", "text"
    )
    return labels, attributes


@query(f"""
    WITH picked AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL ORDER BY {sql_hash(7, 'doc_id')}, doc_id::VARCHAR LIMIT 300),
    answers AS (
        SELECT doc_id, quality, source, lang,
               CASE WHEN lang = 'en' THEN 'The category "1" fits.' WHEN lang = 'fr' THEN '2' ELSE '0' END AS choices,
               CASE WHEN lang = 'en' THEN '1' WHEN lang = 'fr' THEN '2' ELSE '0' END AS category
        FROM picked JOIN documents USING (doc_id)
    )
    SELECT doc_id::VARCHAR AS sample_id, ' lang:' || lang || CASE WHEN source = 'src1' THEN '' ELSE ',source:' || source END || '.' AS prompt,
           choices, category, category IN (SELECT quality::VARCHAR FROM labels) AS is_allowed,
           quality::VARCHAR AS truth, category = quality::VARCHAR AS passed
    FROM answers
""")
def prompt_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for a sample, answered by a rule on the language, compared with the quality label."""
    def by_language(batch):
        def answer(prompt: str) -> str:
            if "lang:en" in prompt:
                return 'The category "1" fits.'
            return "2" if "lang:fr" in prompt else "0"

        return batch.assign(model="rule", choices=batch["prompt"].map(answer), tokens=0)[
            ["sample_id", "model", "choices", "tokens", "prompt"]
        ]

    labels, attributes = _labels_and_attributes(spark, sf)
    prompts = prompt_agreement.prompts(
        labels, attributes, 300, ["lang", "source"], markers=["src1"]
    )
    answers = prompt_agreement.answer_pending(prompts, None, by_language)
    compared = prompt_agreement.agreement(answers, labels)
    return compared.select(
        "sample_id", "prompt", "choices", "category", "is_allowed", "truth", "passed"
    )


@query("""
    SELECT 'tfidf' AS method, quality::VARCHAR AS label, count(*) AS n, true AS in_clusters
    FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality
""")
def cluster_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled records: text, TF-IDF, K-means, labels per cluster. Every record is in one of the clusters."""
    labels, attributes = _labels_and_attributes(spark, sf)
    sample = feature_clusters.labelled_sample(labels, attributes, None, ["lang", "source"])
    features = feature_clusters.tfidf_features(sample, ["text"], STOP_WORDS)
    report = feature_clusters.cluster_report(features, ["tfidf"])
    return report.groupBy("method", "label").agg(
        F.sum("n").alias("n"), F.every(F.col("cluster").between(0, CLUSTERS - 1)).alias("in_clusters")
    )


@query("""
    SELECT p_partkey, p_name || ',' || p_brand || ',' || p_type AS text, true AS in_clusters, 1.0::DOUBLE AS length FROM part
""")
def unlabelled_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by the words of their names and types, in as many clusters as there are sizes."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    found = uc.record_vectors(part, ["p_name", "p_brand", "p_type"], "p_partkey", dimension=20, min_count=1)
    sizes = part.select("p_size").distinct().count()
    placed = uc.cluster_records(found, "p_size")
    return placed.select(
        "p_partkey", "text", F.col("cluster").between(0, sizes - 1).alias("in_clusters"), F.round(norm("vector"), 6).alias("length")
    )


_PART_TOKENS = SQL_TOKENS.replace("(text)", "(value)")


@query(f"""
    WITH numbered AS (
        SELECT p_partkey, trim(p_name) AS p_name, p_brand, p_type, row_number() OVER (ORDER BY p_partkey) AS r FROM part
    ), tags AS (
        SELECT p_partkey, p_type, r, unnest([p_name, p_brand]) AS value FROM numbered
    ), examples AS (
        SELECT row_number() OVER () AS e, * FROM (SELECT DISTINCT p_type, value FROM tags WHERE r <= 500 AND value IS NOT NULL)
    ), words AS (SELECT DISTINCT value, {_PART_TOKENS} AS w FROM tags WHERE value IS NOT NULL),
    grams AS (
        SELECT value, unnest(w) AS term FROM words
        UNION ALL SELECT value, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        UNION ALL SELECT value, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
    ), counted AS (SELECT value, term, count(*) AS tf FROM grams GROUP BY ALL),
    chosen AS (
        SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM examples)) / (count(*) + 1)) + 1 AS idf
        FROM counted JOIN examples USING (value) GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 300
    ), raw AS (SELECT value, term, tf * idf AS x FROM counted JOIN chosen USING (term)),
    weights AS (SELECT value, term, x / sqrt(sum(x * x) OVER (PARTITION BY value)) AS weight FROM raw),
    sizes AS (SELECT p_type, count(*) AS n FROM examples GROUP BY p_type),
    means AS (
        SELECT p_type, term, sum(weight) / any_value(n) AS m FROM weights JOIN examples USING (value) JOIN sizes USING (p_type)
        GROUP BY p_type, term
    ), centres AS (SELECT p_type, term, m / sqrt(sum(m * m) OVER (PARTITION BY p_type)) AS c FROM means),
    scored AS (
        SELECT v.value, s.p_type AS predicted, coalesce((
            SELECT sum(w.weight * c.c) FROM weights w JOIN centres c USING (term) WHERE w.value = v.value AND c.p_type = s.p_type), 0) AS score
        FROM words v CROSS JOIN sizes s
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY value ORDER BY round(score, 12) DESC, predicted) = 1),
    votes AS (
        SELECT p_partkey, p_type, predicted FROM tags JOIN best USING (value) WHERE r > 500 GROUP BY p_partkey, p_type, predicted
        QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY count(*) DESC, predicted) = 1
    )
    SELECT count(*) FILTER (predicted = p_type) AS passed, count(*) AS total, 0::BIGINT AS unmatched,
           round_even(100.0::DOUBLE * count(*) FILTER (predicted = p_type) / nullif(count(*), 0), 0)::DOUBLE AS percent
    FROM votes
""")
def tagger_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """Names and brands of parts as tags, the type as class; tested on the parts not learnt from."""
    part = table(spark, sf, "part").withColumn("p_name", strip("p_name"))
    training, testing = few_shot_tagger.split(part, 500, "p_partkey")
    tagger = few_shot_tagger.train(training, ["p_name", "p_brand"], "p_partkey", "p_type")
    return ev.pass_rate(tagger.evaluate(testing))
