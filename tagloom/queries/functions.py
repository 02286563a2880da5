"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import values as v
from tagloom.operators import enrich as en
from tagloom.queries.registry import SQL_STRIP, query, table


@query(rf"""
    SELECT doc_id, md5(lower(text)) AS lowered,
           md5(regexp_replace(text, '\A{SQL_STRIP}+|{SQL_STRIP}+\z', '', 'g')) AS stripped,
           string_split(text, '. ')[1] AS first_piece,
           md5(regexp_replace(text, '[aeiou]', '', 'g')) AS without_vowels,
           md5(replace(text, chr(10), ' ')) AS one_line,
           starts_with(text, 'The') AS starts_the, ends_with(text, '.') AS ends_dot,
           substr(text, 1, 8) AS shard,
           concat_ws('|', lang, source) AS joined,
           format('{{}}:{{}}', lang, n_chars) AS formatted
    FROM documents
""")
def string_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Lower, strip, split, replace, prefix and suffix tests, prefix slice, join, format."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.lower("text")).alias("lowered"),
        F.md5(v.strip("text")).alias("stripped"),
        v.part("text", ". ", 0).alias("first_piece"),
        F.md5(F.regexp_replace("text", "[aeiou]", "")).alias("without_vowels"),
        F.md5(F.translate("text", "\n", " ")).alias("one_line"),
        F.col("text").startswith("The").alias("starts_the"),
        F.col("text").endswith(".").alias("ends_dot"),
        v.shard("text").alias("shard"),
        F.concat_ws("|", "lang", "source").alias("joined"),
        F.format_string("%s:%d", "lang", "n_chars").alias("formatted"),
    )


@query(r"SELECT page_id, regexp_extract(url, '([^/.]*)[^/]*\z', 1) AS name FROM pages")
def base_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", v.base_name("url").alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 1) AS rounded FROM lineitem")
def round_half_even(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        v.round_half_even(F.col("l_quantity") / 4, 1).alias("rounded"),
    )


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.lang) AS name, l.quality IS NOT NULL AS is_set, "
       "d.n_chars::VARCHAR AS shown FROM documents d LEFT JOIN labels l USING (doc_id)")
def key_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """First set name, null test and cast to text."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id",
        v.first_present(F.col("quality").cast("string"), "lang").alias("name"),
        F.col("quality").isNotNull().alias("is_set"),
        F.col("n_chars").cast("string").alias("shown"),
    )


@query("""
    WITH shaped AS (
        SELECT event_id, CASE WHEN user_id % 2 = 0 THEN props ELSE '[' || props || ']' END AS props FROM events
    )
    SELECT event_id, json_type(props) = 'ARRAY' AS is_array,
           CASE WHEN json_type(props) = 'ARRAY' THEN props ->> '$[0].k' ELSE props ->> '$.k' END::INTEGER AS k,
           '{"k":' || CASE WHEN json_type(props) = 'ARRAY' THEN props ->> '$[0].k' ELSE props ->> '$.k' END
           || '}' AS written
    FROM shaped
""")
def json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Object or array, both parsed as an array and written back."""
    events = table(spark, sf, "events")
    props = F.when(F.col("user_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.lit("["), "props", F.lit("]"))
    )
    shaped = events.select("event_id", props.alias("props"))
    parsed = F.from_json(v.as_json_array("props"), "array<struct<k: int>>")
    return shaped.withColumn("first", F.get(parsed, F.lit(0))).select(
        "event_id",
        v.is_json_array("props").alias("is_array"),
        F.col("first.k").alias("k"),
        F.to_json("first").alias("written"),
    )


@query("SELECT c_custkey, n_name AS country, c_mktsegment AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def place_parts(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat("n_name", F.lit(":"), "c_mktsegment").alias("place")
    )
    return places.select(
        "c_custkey", v.country_part("place").alias("country"), v.region_part("place").alias("region")
    )


@query("""
    SELECT o_orderkey, year(o_orderdate)::INTEGER AS y,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE month(o_orderdate)::INTEGER END AS m,
           CASE WHEN o_orderkey % 4 < 2 OR o_orderkey % 4 = 2 AND o_orderkey % 3 = 0 AND NOT (
                    day(o_orderdate) + 20 <= day(last_day(o_orderdate))) THEN NULL
                WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 = 0 THEN (day(o_orderdate) + 20)::INTEGER
                ELSE day(o_orderdate)::INTEGER END AS d
    FROM orders
""")
def collection_date_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written as year, year-month, day-month-year or in full; some days are 20 days too late, so
    that not all of their months have them."""
    form = F.col("o_orderkey") % 4
    late = F.concat((F.dayofmonth("o_orderdate") + 20).cast("string"), F.date_format("o_orderdate", "-MMM-yyyy"))
    written = (
        F.when(form == 0, F.date_format("o_orderdate", "yyyy"))
        .when(form == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .when((form == 2) & (F.col("o_orderkey") % 3 == 0), late)
        .when(form == 2, F.date_format("o_orderdate", "dd-MMM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", written.alias("written"))
    return orders.select(
        "o_orderkey",
        v.collection_year("written").alias("y"),
        v.collection_month("written").alias("m"),
        v.collection_day("written").alias("d"),
    )


@query("SELECT c_custkey, c_custkey AS number FROM customer")
def numeric_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", v.numeric_id("c_name").alias("number"))


@query("""
    SELECT p_partkey, p_name AS label, 'FOODON_' || p_partkey AS ontology_id FROM part
    UNION ALL SELECT p_partkey, p_type, 'UBERON_' || p_size FROM part
    UNION ALL SELECT p_partkey, p_brand, NULL FROM part
""")
def ontology_terms(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    written = F.format_string(
        "%s:FOODON_%d| %s:UBERON_%d, %s", "p_name", "p_partkey", "p_type", "p_size", "p_brand"
    )
    return en.split_terms(part.select("p_partkey", written.alias("terms")), "terms")
