"""Projections, filters and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import PROMPT_HEAD, PROMPT_SEPARATOR
from tagloom.functions import text as fn
from tagloom.operators import attributes as at
from tagloom.operators import labels as lb
from tagloom.operators import text as tx
from tagloom.queries.registry import SQL_STRIP, query, table

CATEGORIES = ("assistant", "user")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) "
       "WHERE l.quality IS NOT NULL")
def labelled_only(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    both = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return lb.labelled_only(both, "doc_id", "quality").select("doc_id", "quality")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000001%'")
def valid_ids(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return lb.valid_ids(customer, "c_name", "Customer#0000001")


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) IN ('4-not specified', '5-low') THEN NULL "
       "ELSE o_orderpriority END AS o_orderpriority FROM orders")
def drop_null_markers(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return at.null_markers(orders, ["o_orderpriority"], ["4-not specified", "5-low"])


@query("SELECT o_orderkey::VARCHAR AS sample_id, o_orderpriority AS value FROM orders "
       "WHERE lower(o_orderpriority) NOT IN ('4-not specified')")
def drop_null_marker_rows(spark: SparkSession, sf: str) -> DataFrame:
    long = at.to_long(table(spark, sf, "orders"), "o_orderkey", ["o_orderpriority"])
    kept = at.drop_null_markers(long, markers=["4-not specified"])
    return kept.select(F.col("sample_id").cast("string"), "value")


@query("SELECT doc_id AS sample_id, 'lang' AS field, lang AS value FROM documents "
       "UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents")
def select_fields(spark: SparkSession, sf: str) -> DataFrame:
    long = at.to_long(table(spark, sf, "documents"), "doc_id", ["lang", "source", "n_chars"])
    return at.select_fields(long, wanted=["lang"], prefix="n_").select("sample_id", "field", "value")


SQL_CLEAN = (
    rf"regexp_replace(regexp_replace(text, '[\n\[\]]', '', 'g'), '\A{SQL_STRIP}+|{SQL_STRIP}+\z', '', 'g')"
)


@query(f"SELECT doc_id, md5({SQL_CLEAN}) AS digest, length({SQL_CLEAN})::INTEGER AS characters FROM documents")
def clean_value(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", fn.clean_value("text").alias("clean"))
    return docs.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("characters"))


@query(f"SELECT doc_id, md5(concat_ws(' ', source, {SQL_CLEAN}, lang)) AS digest FROM documents")
def assemble_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = tx.assemble_text(table(spark, sf, "documents"), ["source", "text", "lang"], name="joined")
    return docs.select("doc_id", F.md5("joined").alias("digest"))


@query("SELECT doc_id, concat_ws(',', 'lang:' || lang, 'source:' || source, 'n_chars:' || n_chars) AS rendered "
       "FROM documents")
def render_kv(spark: SparkSession, sf: str) -> DataFrame:
    shown = fn.render_pairs(["lang", "source", "n_chars"]).alias("rendered")
    return table(spark, sf, "documents").select("doc_id", shown)


@query("SELECT doc_id, concat_ws(',', lang, n_chars::VARCHAR) AS rendered FROM documents")
def render_values(spark: SparkSession, sf: str) -> DataFrame:
    shown = fn.render_values(["lang", "n_chars"]).alias("rendered")
    return table(spark, sf, "documents").select("doc_id", shown)


@query("SELECT doc_id, CASE WHEN n_chars >= 500 THEN lang ELSE '' END AS text FROM documents WHERE n_chars >= 500")
def drop_empty_text(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts are emptied first."""
    docs = table(spark, sf, "documents")
    shown = docs.select(
        "doc_id", F.when(F.col("n_chars") >= 500, F.col("lang")).otherwise("").alias("text")
    )
    return tx.drop_empty_text(shown)


@query("SELECT d.doc_id, (1 + (l.quality IS NOT NULL)::INT)::INTEGER AS entries, "
       "CASE WHEN l.quality IS NULL THEN 'lang:' || lang ELSE 'lang:' || lang || ',quality:' || l.quality END AS shown "
       "FROM documents d LEFT JOIN labels l USING (doc_id)")
def sparse_attrs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    wide = docs.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("index", F.lit(1))
    kept = at.sparse_attrs(at.to_map(wide, ["lang", "quality", "index"]))
    return kept.select(
        "doc_id", F.size("attrs").alias("entries"), fn.render_map("attrs").alias("shown")
    )


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus FROM orders")
def core_columns(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return at.core_columns(orders, "o_orderkey", ["o_custkey", "o_orderdate", "o_orderstatus"])


SQL_PROMPT_HEAD = " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in PROMPT_HEAD.split("\n"))


@query(f"""
    SELECT doc_id AS sample_id, {SQL_PROMPT_HEAD}
           || (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents))
           || chr(10) || '{PROMPT_SEPARATOR}' || chr(10)
           || 'source:' || source || ',n_chars:' || n_chars || '.' AS prompt
    FROM documents
""")
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return tx.build_prompts(docs, ["source", "n_chars"], lb.class_values(docs, "lang"), "doc_id")


@query("SELECT event_id, props || chr(10) || chr(10) || 'Convert this.' AS prompt FROM events")
def record_with_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", fn.record_prompt("props", "Convert this.").alias("prompt")
    )


@query(f"""
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE
           regexp_replace(' ' || replace(text, chr(10), ' '), '{SQL_STRIP}+\\z', '', 'g') END AS payload
    FROM conversations
""".replace("\\\\z", "\\z"))
def prompt_payload(spark: SparkSession, sf: str) -> DataFrame:
    """System turns have no separator."""
    text = F.when(F.col("role") == "system", F.col("text")).otherwise(
        F.concat("role", F.lit(":: "), "text")
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", fn.prompt_payload(text).alias("payload")
    )


@query("""
    WITH answers AS (
        SELECT conv_id, turn,
               CASE WHEN turn % 2 = 1 THEN 'The record should be assigned to the "' || role || '" category.'
                    ELSE role END AS answer
        FROM conversations
    ), read AS (
        SELECT *, CASE WHEN answer LIKE '%"%' THEN regexp_extract(answer, '"([^"]+)"', 1) ELSE answer END AS category
        FROM answers
    )
    SELECT conv_id, turn, answer, category,
           category IN (SELECT role FROM conversations WHERE role <> 'system') AS is_allowed
    FROM read
""")
def extract_category(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations")
    wordy = F.concat(F.lit('The record should be assigned to the "'), "role", F.lit('" category.'))
    answers = talk.select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 1, wordy).otherwise(F.col("role")).alias("answer")
    )
    return tx.extract_category(answers, "answer", talk.filter("role <> 'system'"), "role")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'Unknown') AS quality, "
       "coalesce(l.toxic::VARCHAR, 'Unknown') AS toxic, 'Unknown' AS host "
       "FROM documents d LEFT JOIN labels l USING (doc_id)")
def default_unknown(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    wide = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return tx.fill_unknown(wide, ["quality", "toxic", "host"])
