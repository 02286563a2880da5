"""The operators applied to the test tables, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import (
    codes,
    embeddings,
    fingerprints,
    jaccard,
    languages,
    licenses,
    lines,
    mixing,
    packing,
    pages,
    search,
    substrings,
    toxicity,
)
from tagloom.llm.shared import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the tokenizer's file is; TAGLOOM_TOKENIZER names another."""
    if path := os.environ.get("TAGLOOM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every text, learned from three quarters of the labelled documents."""
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    # A row without an id is not held out, nor learned from.
    prototypes = languages.learn(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    found = languages.identify(docs, prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Sources dealt so that their weights have 95 % of the greatest entropy, no document left out."""
    return mixing.mix(table(spark, sf, "documents"), entropy=0.95)


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without lines that stand on ten or more sources."""
    return lines.remove_lines(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op4_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, source, text, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS raw
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)),
lines AS (
  SELECT *, trim(regexp_replace(raw, '[\t\x0B\f\r]', ' ', 'g')) AS line FROM cut),
spread AS (
  SELECT line, min({'d': doc_id, 'p': place}) AS first FROM lines
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.*, s.line IS NOT NULL AND {'d': l.doc_id, 'p': l.place} <> s.first AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line),
done AS (
  SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '') AS left_text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN n_removed > 0 THEN left_text ELSE d.text END AS text
FROM documents d LEFT JOIN done USING (doc_id)
"""


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected severity of every text, from the labelled ones."""
    docs = table(spark, sf, "documents")
    model = toxicity.learn(docs, table(spark, sf, "labels"))
    graded = toxicity.grade(docs.select("doc_id", "text"), model)
    return graded.select("doc_id", "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("rejected"))


@query
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All texts as token sequences of at most 1024."""
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are alike by 0.9 or more."""
    return jaccard.jaccard_groups(table(spark, sf, "documents"), length=3, percent=90)


@query
def op8_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of vectors whose cosine is 0.9 or more."""
    return embeddings.near_vectors(table(spark, sf, "embeddings"))


@query
def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """MinHash fingerprints of every text and of its edited form, and the near copies that their bands find."""
    return fingerprints.linked_fingerprints(table(spark, sf, "documents"))


@query
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence notices in all texts, by family."""
    return licenses.scan(table(spark, sf, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words left of every text without 13-word windows of earlier documents."""
    cleaned = substrings.remove_repeats(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
WITH held AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
texts AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM held WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS texts, sum(n)::BIGINT AS terms FROM texts),
postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM texts) GROUP BY ALL),
asked AS (
  SELECT item, item_id, term, count(*) AS qf FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * t.texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals t GROUP BY term, t.texts),
scored AS (
  SELECT a.item, a.item_id, p.row, p.doc_id,
         sum(a.qf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * p.n * t.texts) // t.terms))))::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN postings p USING (term), totals t
  GROUP BY a.item, a.item_id, p.row, p.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM ranked WHERE place <= 10
"""


@query
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen-byte codes of all vectors, and what they lose."""
    return codes.compress(table(spark, sf, "embeddings"))


ORACLES["op12_vector_codes"] = """
WITH RECURSIVE kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, len(embedding) // 16 AS width,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS whole
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, part, whole[part * width + 1 : (part + 1) * width] AS v FROM kept, range(16) AS r(part)),
start AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 64),
near1 AS MATERIALIZED (
  SELECT row, part, any_value(p.v) AS v, min({'d': list_sum(list_transform(list_zip(p.v, s.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'e': entry}) AS best
  FROM parts p JOIN start s USING (part) GROUP BY row, part),
moved1 AS (
  SELECT part, entry, list(value ORDER BY place) AS v FROM (
    SELECT part, best.e AS entry, place, floor(sum(v[place]) / count(*))::BIGINT AS value
    FROM near1, range(1, (SELECT max(len(v)) + 1 FROM near1)) AS r(place) GROUP BY ALL) GROUP BY part, entry),
book1 AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, s.v) AS v FROM start s LEFT JOIN moved1 m USING (part, entry)),
near2 AS MATERIALIZED (
  SELECT row, part, any_value(p.v) AS v, min({'d': list_sum(list_transform(list_zip(p.v, s.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'e': entry}) AS best
  FROM parts p JOIN book1 s USING (part) GROUP BY row, part),
moved2 AS (
  SELECT part, entry, list(value ORDER BY place) AS v FROM (
    SELECT part, best.e AS entry, place, floor(sum(v[place]) / count(*))::BIGINT AS value
    FROM near2, range(1, (SELECT max(len(v)) + 1 FROM near2)) AS r(place) GROUP BY ALL) GROUP BY part, entry),
book2 AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, s.v) AS v FROM book1 s LEFT JOIN moved2 m USING (part, entry)),
near3 AS (
  SELECT row, part, min({'d': list_sum(list_transform(list_zip(p.v, s.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'e': entry}) AS best
  FROM parts p JOIN book2 s USING (part) GROUP BY row, part),
coded AS (
  SELECT row, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near3 GROUP BY row),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), sha
"""


@query
def op13_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_text(table(spark, sf, "pages"))
