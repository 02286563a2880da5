"""Standardising against lookup tables: places, hosts, two-level categories, term lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.constants import CATEGORY_SCHEME, HOST_NAMES
from tagloom.functions import text as fn
from tagloom.functions.arrays import starts_from_lengths, unnest
from tagloom.functions.values import ColumnOrName, as_column, ontology_terms
from tagloom.operators.joins import fits, lookup_join
from tagloom.operators.sieve import sieve
from tagloom.operators.terms import TermTrie, cut

#: Terms, and bytes of them, that are sent to every task; and mentions that leave it in one batch, about.
TRIE_TERMS, TRIE_BYTES, BATCH_MENTIONS = 1_000_000, 32 * 1024 * 1024, 65_536


def category_scheme(spark: SparkSession) -> DataFrame:
    """The two-level scheme as (niche, type) rows."""
    rows = [(niche, kind) for niche, kinds in CATEGORY_SCHEME.items() for kind in kinds]
    return spark.createDataFrame(rows, "niche string, type string")


def host_names(spark: SparkSession) -> DataFrame:
    """The host name table as (common_name, scientific_name) rows."""
    return spark.createDataFrame(list(HOST_NAMES), "common_name string, scientific_name string")


def geo_backfill(
    df: DataFrame, places: DataFrame, country: str, fill: Iterable[str] = ("lat", "lon")
) -> DataFrame:
    """Fill missing place columns from the country's row in ``places``.

    ``places`` has the country in a column of the same name, once. Columns that ``df`` does not
    have are added.
    """
    fill = list(fill)
    found = places.select(
        as_column(country), *[as_column(c).alias(f"__{c}") for c in fill]
    )
    joined = lookup_join(df, found, [country], "left")
    have = set(df.columns)
    filled = {
        c: F.coalesce(as_column(c), F.col(f"__{c}")) if c in have else F.col(f"__{c}") for c in fill
    }
    added = [c for c in fill if c not in have]
    return joined.withColumns(filled).select(*[as_column(c) for c in [*df.columns, *added]])


def host_key(c: ColumnOrName) -> Column:
    """Host names are compared in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(as_column(c)), r"\s+", " "))


def standardise_host(df: DataFrame, names: DataFrame, host: str) -> DataFrame:
    """Adds common and scientific name for a host given by either; null when not known."""
    pairs = names.select(
        "common_name",
        "scientific_name",
        F.explode(F.array(host_key("common_name"), host_key("scientific_name"))).alias("__key"),
    ).filter(F.col("__key").isNotNull())
    # a name listed twice stands for the first pair in order
    synonyms = pairs.groupBy("__key").agg(
        F.min(F.struct("common_name", "scientific_name")).alias("__pair")
    )
    keyed = df.withColumn("__key", host_key(host))
    return lookup_join(keyed, synonyms, ["__key"], "left", measured=pairs).select(
        *[as_column(c) for c in df.columns], "__pair.common_name", "__pair.scientific_name"
    )


def niche_check(df: DataFrame, scheme: DataFrame, niche: str, label: str) -> DataFrame:
    """Adds whether the label is one the scheme lists under its niche."""
    allowed = (
        scheme.select(as_column("niche").alias(niche), as_column("type").alias(label))
        .distinct()
        .withColumn("__ok", F.lit(True))
    )
    return lookup_join(df, allowed, [niche, label], "left", measured=scheme).select(
        *[as_column(c) for c in df.columns],
        F.coalesce(F.col("__ok"), F.lit(False)).alias("in_scheme"),
    )


def split_terms(df: DataFrame, column: str) -> DataFrame:
    """One row per ontology term of a value: label and ontology id."""
    rest = [c for c in df.columns if c != column]
    return unnest(df, ontology_terms(column), rest, "__term").select(
        *[as_column(c) for c in rest], "__term.label", "__term.ontology_id"
    )


def tag_entities(
    df: DataFrame,
    sample_id: str,
    text: str,
    gazetteer: DataFrame,
    term: str = "term",
    label: str = "label",
) -> DataFrame:
    """Mentions of listed terms in text: sample_id, term, label, start, end (in characters).

    Terms are cut into words like the texts and compared in lower case, whatever stands between the
    words; they may have any number of words. A term without any is never found. A list of measured size goes to
    every task, which walks its words as a trie over each text; nothing is shuffled. Of a longer list the texts are
    cut into words with their offsets inside the row, and only runs that begin like a listed term, with
    their offsets, leave it to be joined.
    """
    pairs = gazetteer.select(F.lower(as_column(term)).alias("term"), as_column(label).alias("label"))
    if fits(pairs, TRIE_TERMS, TRIE_BYTES):
        return _tag_by_trie(df, sample_id, text, pairs.distinct())
    return _tag_by_join(df, sample_id, text, gazetteer, term, label)


def listed_terms(pairs: DataFrame) -> tuple[TermTrie, list[Row]]:
    """A trie of the (term, label) rows and the rows by their number. The caller has measured them."""
    rows = sorted((r for r in pairs.collect() if r["term"] is not None), key=lambda r: (r["term"], r["label"] or ""))
    return TermTrie((cut(r["term"])[0], i) for i, r in enumerate(rows)), rows


def _tag_by_trie(df: DataFrame, sample_id: str, text: str, pairs: DataFrame) -> DataFrame:
    trie, rows = listed_terms(pairs)
    shared = df.sparkSession.sparkContext.broadcast(trie)
    texts = df.select(as_column(sample_id).alias("sample_id"), as_column(text).alias("text"))
    terms, labels = pa.array([r["term"] for r in rows], pa.string()), pa.array([r["label"] for r in rows], pa.string())
    schema = T.StructType([texts.schema["sample_id"]])
    schema = schema.add("term", "string").add("label", "string").add("start", "integer").add("end", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            row, number, start, end = [], [], [], []
            for at, value in enumerate(batch.column("text")):
                if len(row) >= BATCH_MENTIONS:
                    yield _mentions(batch, row, number, start, end, terms, labels, schema.names)
                    row, number, start, end = [], [], [], []
                words, begins, ends = cut(value.as_py() or "")
                for first, last, found in find(words):
                    row.append(at)
                    number.append(found)
                    start.append(begins[first])
                    end.append(ends[last])
            yield _mentions(batch, row, number, start, end, terms, labels, schema.names)

    return texts.mapInArrow(run, schema)


def _mentions(batch, row, number, start, end, terms, labels, names) -> pa.RecordBatch:
    which = pa.array(number, pa.int64())
    columns = [batch.column("sample_id").take(pa.array(row, pa.int64())), terms.take(which), labels.take(which)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(start, pa.int32()), pa.array(end, pa.int32())], names)


def _tag_by_join(df: DataFrame, sample_id: str, text: str, gazetteer: DataFrame, term: str, label: str) -> DataFrame:
    listed = (
        gazetteer.select(F.lower(as_column(term)).alias("term"), as_column(label).alias("label"))
        .distinct()
        .withColumn("__cut", F.filter(fn.pieces("term"), lambda p: p.rlike(fn.WORD_CLASS)))
        .filter(F.size("__cut") > 0)
        .select("term", "label", F.array_join("__cut", " ").alias("run"), F.size("__cut").alias("n"), F.get("__cut", F.lit(0)).alias("first"))
    )
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())
    cut = (
        df.select(as_column(sample_id).alias("sample_id"), as_column(text).alias("__text"))
        .select("sample_id", fn.pieces("__text").alias("__pieces"))
        .withColumn("__lengths", F.transform("__pieces", lambda p: F.length(p)))
        .withColumn("__starts", starts_from_lengths("__lengths"))
        # pieces alternate between words and what lies between them
        .withColumn(
            "__odd", F.when(F.get("__pieces", F.lit(0)).rlike(fn.WORD_CLASS), 0).otherwise(1)
        )
    )

    def word_entries(values: Column) -> Column:
        return F.filter(values, lambda _x, i: i % 2 == F.col("__odd"))

    words = cut.select(
        "sample_id",
        word_entries(F.transform("__pieces", lambda p: F.lower(p))).alias("__words"),
        word_entries(F.col("__starts")).alias("__from"),
        word_entries(F.col("__lengths")).alias("__long"),
    )
    starts_a_term = sieve(listed.select("first"))
    places = F.transform("__words", lambda w, i: F.when(starts_a_term(w), i))
    words = words.withColumn("__at", F.filter(places, lambda i: i.isNotNull()))

    def runs(n: int) -> Column:
        last = lambda i: i + F.lit(n - 1)
        run = F.transform(
            "__at",
            lambda i: F.when(
                i + n <= F.size("__words"),
                F.struct(
                    fn.run_of_words(F.col("__words"), F.get("__words", i), i, n).alias("run"),
                    F.get("__from", i).alias("start"),
                    (F.get("__from", last(i)) + F.get("__long", last(i))).alias("end"),
                ),
            ),
        )
        return F.filter(run, lambda r: r.isNotNull())

    if not lengths:
        lengths = [1]
    every_run = F.concat(*[runs(n) for n in lengths])
    found = unnest(words, every_run, ["sample_id"], "run").select("sample_id", "run.*")
    terms = listed.select("run", "term", "label")
    return lookup_join(found, terms, ["run"], measured=gazetteer).select("sample_id", "term", "label", "start", "end")
