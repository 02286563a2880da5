"""TF-IDF, token filtering, embeddings, scaling, tag scores, unknown words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.functions.arrays import unnest
from tagloom.functions.hashing import stable_hash
from tagloom.operators import classify as cf
from tagloom.operators import evaluate as ev
from tagloom.operators import labels as lb
from tagloom.operators import text as tx
from tagloom.operators import tfidf as ti
from tagloom.operators import vectors as vc
from tagloom.queries.aggregates import SQL_LAST_TYPE
from tagloom.queries.joins import (
    DIMENSIONS,
    SQL_COUNTED,
    SQL_TOKEN_TABLE,
    token_table,
)
from tagloom.queries.registry import (
    SQL_STOP_WORDS,
    SQL_TOKENS,
    STOP_WORDS,
    query,
    sql_hash,
    table,
    texts,
)

SQL_WEIGHTS = f"""
    words AS (
        SELECT doc_id, list_filter({SQL_TOKENS}, lambda t: t NOT IN ({SQL_STOP_WORDS})) AS w FROM documents
    ), grams AS (
        SELECT doc_id, unnest(w) AS term FROM words
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1),
            lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
    ), counted AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
    chosen AS (
        SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (count(*) + 1)) + 1 AS idf
        FROM counted GROUP BY term
        HAVING count(*) >= 2 AND count(*) <= 0.7 * (SELECT count(*) FROM documents)
        ORDER BY sum(tf) DESC, term LIMIT 300
    ), raw AS (SELECT doc_id, term, tf * idf AS x FROM counted JOIN chosen USING (term)),
    weights AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""


@query(f"WITH {SQL_WEIGHTS} SELECT doc_id AS sample_id, term, round(weight, 6) AS weight FROM weights")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    model = ti.fit_tfidf(docs, "text", STOP_WORDS)
    weights = model.weights(docs, "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 6))


@query(f"""
    SELECT doc_id AS sample_id, token, count(*) AS n
    FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS token FROM documents)
    WHERE token NOT IN ({SQL_STOP_WORDS}) GROUP BY ALL
""")
def token_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tx.token_counts(texts(spark, sf), "doc_id", "text", STOP_WORDS)


@query(f"""
    WITH tokens AS (SELECT DISTINCT unnest({SQL_TOKENS}) AS token FROM benchmark)
    SELECT token AS form, CASE WHEN token LIKE '%s' AND left(token, length(token) - 1) IN (SELECT token FROM tokens)
        THEN left(token, length(token) - 1) ELSE token END AS token FROM tokens
""")
def lemmatise(spark: SparkSession, sf: str) -> DataFrame:
    """Lemma table: a token with a final s is a form of the one without, where that occurs."""
    tokens = unnest(table(spark, sf, "benchmark"), fn.tokens("text"), [], "token").distinct()
    lemmas = tokens.select(
        F.concat("token", F.lit("s")).alias("token"), F.col("token").alias("lemma")
    )
    return tx.lemmatise(tokens.select(F.col("token").alias("form"), "token"), lemmas)


@query(f"""
    WITH tokens AS (SELECT DISTINCT unnest({SQL_TOKENS}) AS token FROM benchmark),
    pairs AS (
        SELECT token, CASE WHEN token LIKE '%s' AND left(token, length(token) - 1) IN (SELECT token FROM tokens)
            THEN left(token, length(token) - 1) ELSE token END AS lemma
        FROM tokens WHERE {sql_hash(0, 'token')} % 2 = 0
    ), cuts AS (
        SELECT right(token, n) AS suffix, n AS length,
               CASE WHEN left(token, length(token) - n) = left(lemma, length(token) - n) THEN substr(lemma, length(token) - n + 1) END AS replacement
        FROM pairs, range(1, 6) t(n) WHERE length(token) > n
    ), counted AS (SELECT suffix, length, replacement, count(*) AS n FROM cuts GROUP BY ALL),
    best AS (
        SELECT suffix, length, replacement, n FROM (
            SELECT *, sum(n) OVER (PARTITION BY suffix) AS total,
                   row_number() OVER (PARTITION BY suffix ORDER BY replacement IS NULL, n DESC, replacement) AS r FROM counted)
        WHERE r = 1 AND replacement IS NOT NULL AND n >= 2 AND n >= 0.5 * total
    ), forms AS (SELECT DISTINCT unnest({SQL_TOKENS}) AS form FROM documents),
    ruled AS (
        SELECT form, left(form, length(form) - length) || replacement AS lemma FROM forms, range(1, 6) t(k), best
        WHERE length(form) > k AND suffix = right(form, k)
        QUALIFY row_number() OVER (PARTITION BY form ORDER BY length DESC) = 1
    )
    SELECT form, coalesce(p.lemma, r.lemma, form) AS token FROM forms LEFT JOIN pairs p ON p.token = form LEFT JOIN ruled r USING (form)
""")
def lemmatise_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Endings learned from half of the benchmark words, applied to all words of the documents."""
    tokens = unnest(table(spark, sf, "benchmark"), fn.tokens("text"), [], "token").distinct()
    stems = tokens.select(F.concat("token", F.lit("s")).alias("token"), F.col("token").alias("stem"))
    pairs = tokens.join(stems, "token", "left").select("token", F.coalesce("stem", "token").alias("lemma"))
    pairs = pairs.filter(stable_hash(0, "token") % 2 == 0)
    forms = unnest(texts(spark, sf), fn.tokens("text"), [], "form").distinct().withColumn("token", F.col("form"))
    return tx.lemmatise_by_rules(forms, pairs, tx.learn_lemma_rules(pairs))


def _sql_embedding(vector: str, denominator: str) -> str:
    return f"""
        WITH counted AS ({SQL_COUNTED}), vectors AS (SELECT token, {vector} AS vector FROM ({SQL_TOKEN_TABLE})),
        totals AS (SELECT doc_id, len({SQL_TOKENS}) AS words FROM documents),
        sums AS (
            SELECT sample_id, i, sum(n * vector[i]) AS total, sum(n) AS known
            FROM counted JOIN vectors USING (token), range(1, {DIMENSIONS + 1}) t(i) GROUP BY ALL
        )
        SELECT doc_id AS sample_id, (t.i - 1)::INTEGER AS pos, round(coalesce(total / {denominator}, 0), 6) AS x
        FROM totals CROSS JOIN range(1, {DIMENSIONS + 1}) t(i)
        LEFT JOIN sums ON sums.sample_id = totals.doc_id AND sums.i = t.i
    """


SQL_UNIT = "list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector)))"


def _entries(df: DataFrame) -> DataFrame:
    return unnest(df, F.col("vector"), ["sample_id"], "x", "pos").withColumn("x", F.round("x", 6))


@query(_sql_embedding(SQL_UNIT, "known"))
def document_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of unit token vectors over the known tokens."""
    return _entries(
        vc.document_embedding(texts(spark, sf), "doc_id", "text", token_table(spark, sf), DIMENSIONS, stop_words=())
    )


@query(_sql_embedding("vector", "words"))
def document_embedding_all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of plain token vectors, where an unknown token counts as zero."""
    return _entries(
        vc.document_embedding(
            texts(spark, sf), "doc_id", "text", token_table(spark, sf), DIMENSIONS,
            normalize_tokens=False, count_unknown=True, stop_words=(),
        )
    )


@query("""
    SELECT vec_id, (i - 1)::INTEGER AS pos,
           round(embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x
    FROM embeddings, range(1, 65) t(i)
""")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    vectors = vc.l2_normalize(table(spark, sf, "embeddings"), "embedding", "u")
    return unnest(vectors, F.col("u"), ["vec_id"], "x", "pos").withColumn("x", F.round("x", 6))


@query(f"""
    WITH {SQL_WEIGHTS},
    examples AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, text),
    sizes AS (SELECT lang, count(*) AS n FROM examples GROUP BY lang),
    sums AS (SELECT lang, term, sum(weight) AS s FROM weights JOIN examples USING (doc_id) GROUP BY ALL),
    means AS (SELECT lang, term, s / n AS m FROM sums JOIN sizes USING (lang)),
    centres AS (SELECT lang, term, m / sqrt(sum(m * m) OVER (PARTITION BY lang)) AS c FROM means),
    scores AS (
        SELECT d.doc_id, z.lang AS label, coalesce((
            SELECT sum(w.weight * c.c) FROM weights w JOIN centres c ON w.term = c.term
            WHERE w.doc_id = d.doc_id AND c.lang = z.lang), 0) AS score
        FROM documents d CROSS JOIN sizes z
    )
    SELECT doc_id, label AS predicted, round(score, 6) AS score FROM scores
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, label) = 1
""")
def few_shot_tag_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct text of a language is an example tag; all texts are scored."""
    docs = texts(spark, sf)
    model = ti.fit_tfidf(docs, "text", STOP_WORDS)
    examples = model.arrays(ev.tags_by_class(docs, "lang", "text"), "text", "v")
    centres = cf.class_centroids(examples, "lang", "v")
    tags = model.arrays(docs, "text", "v")
    scored = cf.best_classes(tags.select("doc_id", "v"), "v", centres, "lang")
    return scored.select(
        "doc_id", F.col("best.label").alias("predicted"), F.round("best.score", 6).alias("score")
    )


@query(f"""
    WITH best AS (
        SELECT user_id, event_type AS predicted, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY value DESC, event_type) = 1
    ), votes AS (
        SELECT user_id, predicted, count(*) AS votes, avg(value) AS score FROM best GROUP BY user_id, predicted
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, predicted) = 1
    ), last AS ({SQL_LAST_TYPE})
    SELECT user_id, predicted, votes, round(score, 6) AS score, truth, predicted = truth AS passed
    FROM votes JOIN last USING (user_id)
""")
def evaluate_tag_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as classes, values as scores, the user's last event as curated label."""
    events = table(spark, sf, "events").withColumn("tag", F.col("event_id") % 7)
    last = lb.last_wins(events.select("user_id", "event_id", "event_type"), "user_id", "event_id")
    found = ev.evaluate_tags(
        events, last.select("user_id", F.col("event_type").alias("label")), "user_id", "tag",
        "event_type", "value", "label",
    )
    return found.withColumn("score", F.round("score", 6))


@query("""
    SELECT conv_id || '-' || turn AS sample_id, 'length-rule' AS model,
           CASE WHEN length(text) >= 200 THEN 'long' ELSE 'short' END AS choices,
           length(text)::INTEGER AS tokens, text AS prompt
    FROM conversations u WHERE role = 'user' AND NOT EXISTS (
        SELECT 1 FROM conversations a
        WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1)
""")
def score_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts without an answer, scored by a rule on their length."""
    from tagloom.queries.joins import _prompts_and_answers

    def by_length(batch):
        return batch.assign(
            model="length-rule",
            tokens=batch["text"].str.len(),
            choices=batch["text"].str.len().map(lambda n: "long" if n >= 200 else "short"),
        ).rename(columns={"text": "prompt"})[["sample_id", "model", "choices", "tokens", "prompt"]]

    pending = lb.pending_prompts(*_prompts_and_answers(spark, sf))
    return cf.score_batches(pending, by_length, ["sample_id", "text"])


@query(f"""
    WITH words AS (SELECT lang, unnest({SQL_TOKENS}) AS token FROM documents),
    known AS (SELECT DISTINCT unnest({SQL_TOKENS}) AS token FROM benchmark)
    SELECT lang, count(*) AS words, sum((k.token IS NULL)::INT)::BIGINT AS unrecognised,
           round(sum((k.token IS NULL)::INT) / count(*), 6) AS share
    FROM words LEFT JOIN known k USING (token) GROUP BY lang
""")
def unrecognised_terms(spark: SparkSession, sf: str) -> DataFrame:
    known = unnest(table(spark, sf, "benchmark"), fn.tokens("text"), [], "token")
    return tx.unrecognised_share(texts(spark, sf), "text", "lang", known)
