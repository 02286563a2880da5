"""Round trips through every reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.arrays import unnest
from tagloom.operators import attributes as at
from tagloom.operators import labels as lb
from tagloom.queries.registry import accession, query, table
from tagloom.session import scratch_path
from tagloom.sources import readers, writers

SQL_ACCESSION = "'SAMN' || lpad(doc_id::VARCHAR, 8, '0')"


def _record(sample_id, **fields):
    """A JSON record document with the given attributes."""
    listed = [
        F.struct(F.lit(name).alias("@attribute_name"), value.cast("string").alias("#text"))
        for name, value in fields.items()
    ]
    return F.to_json(
        F.struct(
            sample_id.alias("@accession"),
            F.struct(F.array(*listed).alias("Attribute")).alias("Attributes"),
        )
    )


@query("SELECT doc_id::VARCHAR AS sample_id, quality::VARCHAR AS source_type, "
       "toxic::VARCHAR AS source_niche FROM labels")
def read_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    shown = table(spark, sf, "labels").select(
        F.col("doc_id").alias("Sample ID"),
        F.col("quality").alias("Source Type"),
        F.col("toxic").alias("Source Niche"),
    )
    writers.write_report(shown, path, compression="gzip")
    return readers.read_labels(spark, path)


@query("SELECT doc_id::VARCHAR AS sample_id, lang, source, md5(text) AS digest, "
       "length(text)::INTEGER AS characters FROM documents")
def read_attributes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "attributes")
    docs = table(spark, sf, "documents")
    writers.write_attributes(
        docs.select(F.col("doc_id").alias("Sample ID"), "lang", "source", "text"), path
    )
    return readers.read_attributes(spark, path).select(
        F.col("Sample ID").alias("sample_id"),
        "lang",
        "source",
        F.md5("text").alias("digest"),
        F.length("text").alias("characters"),
    )


@query("SELECT s_name AS sample_id, 'nation' AS field, s_nationkey::VARCHAR AS value FROM supplier "
       "UNION ALL SELECT s_name, 'key', s_suppkey::VARCHAR FROM supplier")
def read_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "records")
    supplier = table(spark, sf, "supplier")
    raw = supplier.select(
        F.col("s_name").alias("sample_id"),
        _record(F.col("s_name"), nation=F.col("s_nationkey"), key=F.col("s_suppkey")).alias("raw"),
    )
    writers.write_raw_records(raw, path, records_per_file=1)
    parsed = at.parse_records(readers.read_records(spark, path))
    return at.long_attributes(at.good_records(parsed)).select("sample_id", "field", "value")


@query("""
    WITH raw AS (
        SELECT event_id, event_type,
               CASE WHEN event_type = 'error' THEN left(props, length(props) - 1)
                    WHEN event_id % 11 = 3 THEN props || ' more' ELSE props END AS raw
        FROM events
    )
    SELECT event_id, CASE WHEN NOT json_valid(raw) OR event_id % 11 = 5 THEN 'malformed' ELSE 'no_id' END AS problem
    FROM raw WHERE NOT json_valid(raw) OR event_id % 11 = 5 OR event_type = 'click'
""")
def quarantine_bad(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are cut short so that they do not parse, clicks have no id.

    Some records have text behind them or single quotes, which is no JSON; some have an empty text or
    list for their attributes, which is good.
    """
    events = table(spark, sf, "events")
    kind = F.col("event_id") % 11
    props = F.when(
        F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")
    ).when(kind == 3, F.concat("props", F.lit(" more"))).otherwise(F.col("props"))
    empty = F.when(kind == 7, '"Attributes":"",').when(kind == 8, '"Attributes":[],').otherwise("")
    with_id = F.concat(
        F.lit('{"@accession":"'), F.col("event_id").cast("string"), F.lit('",'), empty,
        F.substr(props, F.lit(2)),
    )
    raw = F.when(F.col("event_type") == "click", props).otherwise(with_id)
    raw = F.when(kind == 5, F.translate(raw, '"', "'")).otherwise(raw)
    parsed = at.parse_records(events.select("event_id", raw.alias("raw")))
    return at.bad_records(parsed).select("event_id", "problem")


@query("SELECT event_id, (props ->> '$.k')::INTEGER AS k FROM events")
def unwrap_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Records of odd users are put into an envelope first."""
    events = table(spark, sf, "events")
    enveloped = F.concat(F.lit('{"BioSampleSet":{"BioSample":'), F.col("props"), F.lit("}}"))
    raw = events.select(
        "event_id",
        F.when(F.col("user_id") % 2 == 1, enveloped).otherwise(F.col("props")).alias("raw"),
    )
    return at.unwrap_envelope(raw).select(
        "event_id", F.get_json_object("raw", "$.k").cast("int").alias("k")
    )


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("id", accession("doc_id"))
    return at.field_dictionary(at.to_long(docs, "id", ["lang", "source", "n_chars"]))


SQL_LONG = f"""
    SELECT {SQL_ACCESSION} AS sample_id, 'lang' AS field, lang AS value FROM documents
    UNION ALL SELECT {SQL_ACCESSION}, 'source', source FROM documents
    UNION ALL SELECT {SQL_ACCESSION}, 'n_chars', n_chars::VARCHAR FROM documents
"""


@query(f"SELECT DISTINCT field FROM ({SQL_LONG}) WHERE value IS NOT NULL")
def read_field_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "fields")
    writers.write_fields(_fields(spark, sf), path)
    return readers.read_field_dictionary(spark, path)


@query(f"SELECT field || ', again' AS field, min(sample_id) AS first_seen FROM ({SQL_LONG}) "
       "WHERE value IS NOT NULL GROUP BY field")
def write_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A comma in a field name survives."""
    path = scratch_path(spark, "fields")
    named = _fields(spark, sf).withColumn("field", F.concat("field", F.lit(", again")))
    writers.write_fields(named, path)
    return spark.read.csv(path, header=True, quote='"', escape='"')


@query("SELECT conv_id || '-' || turn AS sample_id, 'rule' AS model, role AS choices, "
       "length(text)::INTEGER AS tokens, text AS prompt FROM conversations")
def read_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"),
        F.lit("rule").alias("model"),
        F.col("role").alias("choices"),
        F.length("text").alias("tokens"),
        F.col("text").alias("prompt"),
    ).write.json(path)
    return readers.read_predictions(spark, path, id_from_file=False)


@query("SELECT 'N' || n_nationkey AS code, n_nationkey * 1.5::DOUBLE AS lat, "
       "n_nationkey * -2.5::DOUBLE AS lon, n_name AS name FROM nation")
def read_geo_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "places")
    table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")),
        F.col("n_nationkey") * F.lit(1.5),
        F.col("n_nationkey") * F.lit(-2.5),
        "n_name",
    ).write.csv(path, sep="\t")
    return readers.read_geo_lookup(spark, path)


@query("SELECT vec_id, (i - 1)::INTEGER AS pos, embedding[i]::DOUBLE AS value "
       "FROM embeddings, range(1, 65) t(i)")
def parse_vector_text(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    parsed = readers.read_vectors(writers.with_columns_as_text(vectors, ["vector"]), ["vector"])
    return unnest(parsed, F.col("vector"), ["vec_id"], "value", "pos")


@query(f"SELECT {SQL_ACCESSION} AS sample_id, 'lang' AS field, lang AS value FROM documents "
       f"UNION ALL SELECT {SQL_ACCESSION}, 'origin', source FROM documents")
def read_record_xml(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "xml")

    def attribute(name: str, harmonized: str | None, value: str):
        return F.struct(
            F.lit(name).alias("_attribute_name"),
            F.lit(harmonized).cast("string").alias("_harmonized_name"),
            F.col(value).alias("_VALUE"),
        )

    listed = F.array(attribute("lang", None, "lang"), attribute("source", "origin", "source"))
    table(spark, sf, "documents").select(
        accession("doc_id").alias("_accession"),
        F.struct(listed.alias("Attribute")).alias("Attributes"),
    ).write.format("xml").option("rootTag", "BioSampleSet").option("rowTag", "BioSample").save(path)
    records = readers.read_record_xml(spark, path)
    return at.long_attributes(records).select("sample_id", "field", "value")


@query("SELECT p_partkey::VARCHAR AS sample_id, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part")
def write_attributes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    wide = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample_id"), "p_name", "p_brand", "p_type", "p_size"
    )
    writers.write_attributes(wide, path)
    return readers.read_attributes(spark, path, multi_line=False)


@query(f"SELECT {SQL_ACCESSION} AS sample_id, substr({SQL_ACCESSION}, 1, 8) AS shard, lang, source FROM documents")
def write_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sharded")
    docs = table(spark, sf, "documents").select(accession("doc_id").alias("sample_id"), "lang", "source")
    writers.write_records(docs, path)
    return spark.read.schema("sample_id string, lang string, source string, shard string").json(path)


@query(f"SELECT {SQL_ACCESSION} AS sample_id, substr({SQL_ACCESSION}, 1, 8) AS shard, "
       "'lang:' || lang || ',source:' || source AS prompt FROM documents")
def write_prompts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prompts")
    prompts = table(spark, sf, "documents").select(
        accession("doc_id").alias("sample_id"),
        F.concat(F.lit("lang:"), "lang", F.lit(",source:"), "source").alias("prompt"),
    )
    writers.write_prompts(prompts, path)
    return spark.read.schema("sample_id string, prompt string, shard string").parquet(path)


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY lang")
def create_or_load(spark: SparkSession, sf: str) -> DataFrame:
    """Built by the first call, read by the second."""
    path = scratch_path(spark, "stored")

    def build() -> DataFrame:
        return table(spark, sf, "documents").groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("characters")
        )

    writers.create_or_load(spark, path, build)
    return writers.create_or_load(spark, path, build)


@query("SELECT user_id::VARCHAR AS record, event_type, count(*)::VARCHAR AS n FROM events GROUP BY ALL")
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    report = table(spark, sf, "events").groupBy(F.col("user_id").alias("record"), "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    writers.write_report(report, path)
    return spark.read.csv(path, sep="\t", header=True)


@query("""
    SELECT conv_id || '-' || turn AS sample_id, role AS choices FROM conversations
""")
def stored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the even turns are stored, then the pending ones added, and all read back."""
    path = scratch_path(spark, "answers")
    prompts = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"),
        F.lit("rule").alias("model"),
        F.col("role").alias("choices"),
        F.length("text").alias("tokens"),
        F.col("text").alias("prompt"),
        F.col("turn"),
    )
    writers.write_predictions(prompts.filter("turn % 2 = 0"), path)
    stored = readers.read_predictions(spark, path, id_from_file=False)
    writers.write_predictions(lb.pending_prompts(prompts, stored), path)
    writers.write_predictions(prompts, path)  # nothing is left to add
    return readers.read_predictions(spark, path, id_from_file=False).select("sample_id", "choices")


@query("SELECT s_name AS sample_id, s_nationkey::VARCHAR AS upper_name, s_suppkey::VARCHAR AS lower_name FROM supplier")
def read_attributes_case(spark: SparkSession, sf: str) -> DataFrame:
    """A table with two columns whose names differ only in case."""
    path = scratch_path(spark, "names")
    rows = table(spark, sf, "supplier").select("s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    # every part is written with the header, so the table may have any number of parts
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows.toDF("sample_id", "Species", "species").write.csv(path, header=True)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    found = readers.read_attributes(spark, path)
    if found.columns != ["sample_id", "Species", "species"]:
        raise ValueError(found.columns)
    return found.toDF("sample_id", "upper_name", "lower_name")


@query("""
    SELECT s_name AS sample_id, (t.i - 1)::INTEGER AS pos, CASE i WHEN 1 THEN 'Species' ELSE 'species' END AS field,
           CASE i WHEN 1 THEN s_nationkey ELSE s_suppkey END::VARCHAR AS value
    FROM supplier, range(1, 3) t(i)
""")
def long_attributes_case(spark: SparkSession, sf: str) -> DataFrame:
    """Columns whose names differ only in case, below each other."""
    found = table(spark, sf, "supplier").select("s_name", "s_nationkey", "s_suppkey").toDF("sample_id", "Species", "species")
    return at.to_long(found, "sample_id", ["Species", "species"])
