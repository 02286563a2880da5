"""Joins: labels, stored answers, places, hosts, schemes, entities, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.functions.arrays import unnest
from tagloom.operators import enrich as en
from tagloom.operators import evaluate as ev
from tagloom.operators import labels as lb
from tagloom.operators import text as tx
from tagloom.operators import vectors as vc
from tagloom.queries.registry import SQL_TOKENS, query, table, texts

DIMENSIONS = 4


def token_table(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for every token of the benchmark texts, from the digits of its md5."""
    tokens = unnest(table(spark, sf, "benchmark"), fn.tokens("text"), [], "token").distinct()
    digits = [
        F.conv(F.substring(F.md5("token"), 1 + 4 * d, 4), 16, 10).cast("double") / 65535 - 0.5
        for d in range(DIMENSIONS)
    ]
    return tokens.select("token", F.array(*digits).alias("vector"))


SQL_TOKEN_TABLE = f"""
    SELECT token, list_transform(range(0, {DIMENSIONS}),
               lambda d: ('0x' || substr(md5(token), (1 + 4 * d)::INT, 4))::BIGINT / 65535.0::DOUBLE - 0.5) AS vector
    FROM (SELECT DISTINCT unnest({SQL_TOKENS}) AS token FROM benchmark)
"""
SQL_COUNTED = f"""
    SELECT doc_id AS sample_id, token, count(*) AS n
    FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS token FROM documents) GROUP BY ALL
"""


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def label_records(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lb.label_records(docs, table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def restrict_to_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lb.restrict_to_ids(docs, table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_records(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lb.missing_records(docs, table(spark, sf, "labels"), "doc_id")


def _prompts_and_answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    talk = table(spark, sf, "conversations")
    prompts = talk.filter("role = 'user'").select("conv_id", "turn", "text")
    answers = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return (
        prompts.withColumn("sample_id", key).select("sample_id", "text"),
        answers.withColumn("sample_id", key).select("sample_id"),
    )


SQL_PENDING = """
    SELECT conv_id || '-' || turn AS sample_id, text FROM conversations u
    WHERE role = 'user' AND NOT EXISTS (
        SELECT 1 FROM conversations a
        WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1)
"""


@query(SQL_PENDING)
def pending_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return lb.pending_prompts(*_prompts_and_answers(spark, sf))


@query("SELECT conv_id || '-' || turn AS sample_id, text FROM conversations WHERE role = 'user'")
def pending_prompts_force(spark: SparkSession, sf: str) -> DataFrame:
    return lb.pending_prompts(*_prompts_and_answers(spark, sf), force=True)


@query("""
    SELECT d.doc_id, (d.doc_id % 2)::INTEGER AS predicted, l.quality AS truth,
           coalesce(l.quality = d.doc_id % 2, false) AS passed
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def compare_predictions(spark: SparkSession, sf: str) -> DataFrame:
    predictions = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 2).cast("int").alias("predicted")
    )
    return ev.compare_predictions(predictions, table(spark, sf, "labels"), "doc_id", label="quality")


@query(f"""
    SELECT sample_id, token, n, round(vector[1], 9) AS x
    FROM ({SQL_COUNTED}) JOIN ({SQL_TOKEN_TABLE}) USING (token)
""")
def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    counted = tx.token_counts(texts(spark, sf), "doc_id", "text", ())
    found = vc.token_vectors(counted, token_table(spark, sf))
    return found.select("sample_id", "token", "n", F.round(F.get("vector", F.lit(0)), 9).alias("x"))


@query("""
    SELECT c_custkey, n_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE n_nationkey * 1.5::DOUBLE END AS lat,
           r_name AS continent
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def geo_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three customers have no latitude of their own, none has a continent."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_name", (F.col("n_nationkey") * F.lit(1.5)).alias("lat"), F.col("r_name").alias("continent")
    )
    customer = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("n_name"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("lat"),
    )
    return en.geo_backfill(customer, places, "n_name", ["lat", "continent"])


@query("""
    WITH names AS (SELECT n_name AS common_name, 'Species ' || n_nationkey AS scientific_name FROM nation),
    hosts AS (
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' nation_' || s_nationkey
               WHEN s_suppkey % 3 = 1 THEN 'SPECIES  ' || s_nationkey ELSE 'Yeti' END AS host FROM supplier
    )
    SELECT s_suppkey, host, common_name, scientific_name FROM hosts LEFT JOIN names
        ON trim(regexp_replace(lower(host), '\\s+', ' ', 'g')) IN (lower(common_name), lower(scientific_name))
""".replace("\\\\", "\\"))
def standardise_host(spark: SparkSession, sf: str) -> DataFrame:
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    number = F.col("s_nationkey").cast("string")
    names = nation.select(
        F.col("n_name").alias("common_name"),
        F.concat(F.lit("Species "), F.col("n_nationkey").cast("string")).alias("scientific_name"),
    )
    host = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" nation_"), number))
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("SPECIES  "), number))
        .otherwise("Yeti")
    )
    return en.standardise_host(supplier.select("s_suppkey", host.alias("host")), names, "host")


@query("""
    WITH scheme AS (SELECT r_name AS niche, n_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey),
    picked AS (
        SELECT c_custkey, r_name AS niche, 'NATION_' || c_nationkey AS type
        FROM customer JOIN region ON r_regionkey = c_custkey % 5
    )
    SELECT c_custkey, niche, type, EXISTS (
        SELECT 1 FROM scheme s WHERE s.niche = p.niche AND s.type = p.type) AS in_scheme
    FROM picked p
""")
def niche_check(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    scheme = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("niche"), F.col("n_name").alias("type")
    )
    picked = table(spark, sf, "customer").join(
        region, F.col("c_custkey") % 5 == F.col("r_regionkey")
    ).select(
        "c_custkey",
        F.col("r_name").alias("niche"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("type"),
    )
    return en.niche_check(picked, scheme, "niche", "type")


@query(r"""
    WITH cut AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS piece,
               generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i
        FROM documents
    ), placed AS (
        SELECT doc_id, i, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece))::INTEGER AS s
        FROM cut
    ), words AS (
        SELECT doc_id, s, (s + length(piece))::INTEGER AS e, lower(piece) AS w,
               lead(lower(piece)) OVER o AS w2, lead((s + length(piece))::INTEGER) OVER o AS e2
        FROM placed WHERE regexp_matches(piece, '[\p{L}\p{N}_]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    ), listed AS (
        SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS h FROM benchmark
    ), terms AS (
        SELECT DISTINCT term, 'word' AS label FROM (SELECT unnest(h) AS term FROM listed) WHERE length(term) >= 6
        UNION SELECT DISTINCT unnest(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])), 'phrase'
        FROM listed
    ), found AS (
        SELECT doc_id, w AS term, s, e FROM words UNION ALL
        SELECT doc_id, w || ' ' || w2, s, e2 FROM words WHERE w2 IS NOT NULL
    )
    SELECT doc_id AS sample_id, term, label, s AS start, e AS end FROM found JOIN terms USING (term)
""")
def tag_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Words of six letters or more and all pairs of words of the benchmark texts as term list."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(fn.WORD_CLASS + "+"), F.lit(0))
    words = table(spark, sf, "benchmark").select(found.alias("words"))
    single = unnest(words, F.col("words"), [], "term").filter(F.length("term") >= 6)
    pairs = unnest(words, fn.ngrams("words", 2, 2), [], "term")
    terms = single.distinct().withColumn("label", F.lit("word")).unionByName(
        pairs.distinct().withColumn("label", F.lit("phrase"))
    )
    return en.tag_entities(texts(spark, sf), "doc_id", "text", terms)


@query(r"""
    WITH words AS (
        SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w) AS h FROM documents
    ), listed AS (
        SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS h FROM benchmark
    ), terms AS (
        SELECT DISTINCT h[i] || '-' || h[i + 1] || '/' || h[i + 2] || ' ' || h[i + 3] AS term,
               h[i] || ' ' || h[i + 1] || ' ' || h[i + 2] || ' ' || h[i + 3] AS run
        FROM listed, range(1, len(h)) t(i) WHERE i + 3 <= len(h)
    ), found AS (
        SELECT doc_id, h[i] || ' ' || h[i + 1] || ' ' || h[i + 2] || ' ' || h[i + 3] AS run
        FROM words, range(1, len(h)) t(i) WHERE i + 3 <= len(h)
    )
    SELECT doc_id AS sample_id, term, count(*) AS n FROM found JOIN terms USING (run) GROUP BY ALL
""")
def tag_entities_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Listed terms of four words with a hyphen and a slash, however the texts write them."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(fn.WORD_CLASS + "+"), F.lit(0))
    runs = unnest(table(spark, sf, "benchmark").select(found.alias("words")), fn.ngrams("words", 4, 4), [], "run")
    term = F.regexp_replace("run", r"^(\S+) (\S+) (\S+) (\S+)$", "$1-$2/$3 $4")
    terms = runs.select(term.alias("term"), F.lit("phrase").alias("label")).distinct()
    mentions = en.tag_entities(texts(spark, sf), "doc_id", "text", terms)
    return mentions.groupBy("sample_id", "term").agg(F.count(F.lit(1)).alias("n"))


SQL_COSINE = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@query(f"""
    WITH entries AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
    centres AS (SELECT label, list(x ORDER BY i) AS v FROM entries GROUP BY label),
    scored AS (
        SELECT c.label, e.vec_id, {SQL_COSINE.format(a='c.v', b='e.embedding::DOUBLE[]')} AS s
        FROM centres c, embeddings e
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM scored)
    SELECT label AS query_id, r::INTEGER AS rank, vec_id AS vector_id, round(s, 6) AS similarity FROM ranked WHERE r <= 3
""")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to the mean of every label."""
    vectors = table(spark, sf, "embeddings")
    centres = vc.mean_vector(vectors, "label", "embedding", "query_vector")
    found = vc.nearest_neighbours(vectors, centres, 3, "vec_id", "embedding", query_id="label")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""
    WITH scored AS (
        SELECT a.vec_id AS q, b.vec_id AS v, {SQL_COSINE.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')} AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS r FROM scored)
    SELECT q AS query_id, r::INTEGER AS rank, v AS vector_id, round(s, 6) AS similarity FROM ranked WHERE r <= 3
""")
def top_k_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The three vectors most like each vector."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vc.nearest_neighbours(vectors, queries, 3, "vec_id", "embedding", exclude_same_id=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
           round({SQL_COSINE.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector and the next."""
    vectors = table(spark, sf, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    found = vc.pair_distance(pairs, vectors, "vec_id", "embedding")
    return found.select(
        "a", "b", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity")
    )
