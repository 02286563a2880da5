"""Weights, samples, splits, batches, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import cluster as cl
from tagloom.operators import evaluate as ev
from tagloom.operators import labels as lb
from tagloom.operators import text as tx
from tagloom.queries.registry import (
    SQL_TOKENS,
    query,
    sql_hash,
    sql_uniform,
    table,
    texts,
)


@query("SELECT doc_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS weight FROM documents")
def class_weight(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lb.class_weight(docs, "lang").select("doc_id", "weight")


@query("SELECT doc_id, (count(*) OVER (PARTITION BY lang))::DOUBLE AS weight FROM documents")
def class_weight_proportional(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lb.class_weight(docs, "lang", equal=False).select("doc_id", "weight")


@query("SELECT doc_id, rn <= 300 AS is_training FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
def split_first_n(spark: SparkSession, sf: str) -> DataFrame:
    return lb.split_first_n(table(spark, sf, "documents").select("doc_id"), 300, "doc_id")


@query(f"SELECT doc_id, ((row_number() OVER (ORDER BY {sql_hash(0, 'doc_id')}, doc_id) - 1) // 100)::BIGINT AS batch FROM documents")
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    return lb.batch_ids(table(spark, sf, "documents"), "doc_id", 100)


@query("""
    SELECT user_id, tag, event_type AS predicted, value AS score FROM (
        SELECT user_id, (event_id % 7)::BIGINT AS tag, event_type, value, row_number() OVER (
            PARTITION BY user_id, event_id % 7 ORDER BY value DESC, event_type) AS r FROM events) WHERE r = 1
""")
def best_class_per_tag(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("tag", F.col("event_id") % 7)
    return ev.best_class_per_tag(events, ["user_id", "tag"], "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events "
       "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return lb.last_wins(events, "user_id", "event_id")


@query(f"""
    SELECT doc_id, lang FROM (SELECT doc_id, lang, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS w FROM documents)
    ORDER BY -ln({sql_uniform(7, 'doc_id')}) / w, doc_id LIMIT 200
""")
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    weighted = lb.class_weight(table(spark, sf, "documents").select("doc_id", "lang"), "lang")
    return lb.weighted_sample(weighted, 200, "weight", "doc_id").drop("weight")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {sql_hash(7, 'doc_id')}, doc_id LIMIT 200")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return lb.uniform_sample(table(spark, sf, "documents").select("doc_id", "lang"), 200, "doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000")
def head(spark: SparkSession, sf: str) -> DataFrame:
    return lb.head(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 1000, "o_orderkey")


_TEXT_KEY = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'SAMN' || lpad((o_orderkey % 97)::VARCHAR, 8, '0') END"


def _text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a text key that is null for one in ten and often repeated."""
    number = F.lpad((F.col("o_orderkey") % 97).cast("string"), 8, "0")
    key = F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("SAMN"), number))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("sample_id"))


@query(f"SELECT o_orderkey, {_TEXT_KEY} AS sample_id FROM orders ORDER BY sample_id NULLS FIRST, o_orderkey LIMIT 700")
def head_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    return lb.head(_text_keys(spark, sf), 700, "sample_id", "o_orderkey")


@query(f"""
    SELECT o_orderkey, {_TEXT_KEY} AS sample_id,
        row_number() OVER (ORDER BY {_TEXT_KEY} NULLS FIRST, o_orderkey) <= 555 AS is_training FROM orders
""")
def split_first_n_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    return lb.split_first_n(_text_keys(spark, sf), 555, "sample_id", ties=("o_orderkey",))


@query("SELECT lang AS cluster, source AS label, count(*) AS n FROM documents GROUP BY ALL ORDER BY 1, n DESC, 2")
def sorted_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("cluster"), F.col("source").alias("label"))
    return cl.cluster_composition(docs, "cluster", "label")


@query(f"""
    SELECT token, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS token FROM documents)
    GROUP BY token ORDER BY n DESC, token LIMIT 300
""")
def top_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return tx.top_vocabulary(texts(spark, sf), "text", 300)


@query(f"SELECT doc_id, {sql_uniform(76, 'doc_id')} <= 0.25 AS is_test FROM documents")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return lb.train_test_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(f"""
    SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(76, 'doc_id')}, doc_id)
        <= ceil(0.25 * (SELECT count(*) FROM documents)) AS is_test FROM documents
""")
def train_test_split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return lb.train_test_split(table(spark, sf, "documents").select("doc_id"), "doc_id", exact=True)


@query("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS label_no FROM documents")
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lb.encode_labels(table(spark, sf, "documents").select("doc_id", "lang"), "lang")
