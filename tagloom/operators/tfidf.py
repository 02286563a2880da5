"""TF-IDF over word n-grams with a fixed number of features.

Fitting counts words and n-grams over the whole corpus; tasks add up what they hold, so it shuffles counts, not texts.
Each text is then turned into a vector on its own, without a shuffle: the vocabulary is the only thing
shared, and its size is the number of features. Words are cut by Spark; their numbers are counted in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import (
    ENGLISH_STOP_WORDS,
    TFIDF_MAX_DF,
    TFIDF_MAX_FEATURES,
    TFIDF_MIN_DF,
    TFIDF_NGRAMS,
)
from tagloom.functions import text as fn
from tagloom.functions.values import as_column
from tagloom.operators.sieve import sieve

#: Words that are counted together.
BATCH_WORDS = 1 << 20


@dataclass(frozen=True)
class TfidfModel:
    """Vocabulary in sorted order with inverse document frequencies."""

    terms: list[str]
    idf: list[float]
    ngram_range: tuple[int, int]
    stop_words: tuple[str, ...]

    def transform(self, df: DataFrame, text: str, name: str = "tfidf") -> DataFrame:
        """Adds a sparse vector: count times idf, scaled to length 1; all zero without a term."""
        if not self.terms:
            raise ValueError("the vocabulary is empty: no term passed the frequency limits")
        words = sorted({w for t in self.terms for w in t.split(" ")})
        only = sieve(df.sparkSession.createDataFrame([(w,) for w in words], "word string"))
        grams = _with_grams(df, text, self.ngram_range, self.stop_words, only)
        counter = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="__grams", outputCol="__tf"
        )
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="__tf", outputCol="__weighted"
        )
        scale = Normalizer(p=2.0, inputCol="__weighted", outputCol=name)
        out = scale.transform(weigh.transform(counter.transform(grams)))
        return out.drop("__words", "__grams", "__tf", "__weighted")

    def arrays(self, df: DataFrame, text: str, name: str = "tfidf") -> DataFrame:
        """Adds the same weights as an array with an entry for every term; for null texts all are zero."""
        lookup = _Lookup.of(self)

        @F.arrow_udf("array<double>")
        def weigh(tokens: pa.Array) -> pa.Array:
            rows, terms, weights = lookup.weights(tokens)
            dense = np.zeros((len(tokens), len(lookup.idf)))
            dense[rows, terms] = weights
            return pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), dense.shape[1]).cast(pa.list_(pa.float64()))

        return df.withColumn(name, weigh(fn.tokens(text, self.stop_words)))

    def weights(self, df: DataFrame, sample_id: str, text: str) -> DataFrame:
        """The same as rows (sample_id, term, weight), without zeros."""
        lookup, names = _Lookup.of(self), pa.array(self.terms, pa.string())
        tokens = df.select(as_column(sample_id).alias("sample_id"), fn.tokens(text, self.stop_words).alias("w"))
        schema = tokens.drop("w").schema.add("term", "string").add("weight", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, terms, weights = lookup.weights(batch.column("w"))
                ids = batch.column("sample_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, names.take(pa.array(terms)), pa.array(weights)], schema.names)

        return tokens.mapInArrow(run, schema)


@dataclass(frozen=True)
class _Lookup:
    """The vocabulary as numbers: of the words in it, and of its terms by the numbers of their words."""

    words: pa.Array
    codes: dict[int, tuple[np.ndarray, np.ndarray]]  # words in a term -> codes in order, the terms' numbers
    idf: np.ndarray

    @staticmethod
    def of(model: TfidfModel) -> _Lookup:
        if not model.terms:
            raise ValueError("the vocabulary is empty: no term passed the frequency limits")
        words = sorted({w for t in model.terms for w in t.split(" ")})
        number = {w: i + 1 for i, w in enumerate(words)}
        found: dict[int, list[tuple[int, int]]] = {}
        for place, term in enumerate(model.terms):
            parts, code = term.split(" "), 0
            for word in parts:
                code = code * (len(words) + 1) + number[word]
            found.setdefault(len(parts), []).append((code, place))
        codes = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) for n, rows in found.items()}
        return _Lookup(pa.array(words, pa.string()), codes, np.array(model.idf))

    def weights(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of a column of word lists, scaled to length 1 for each row."""
        flat, owner = _flat(tokens)
        number = np.asarray(pc.fill_null(pc.index_in(flat, self.words), -1), np.int64) + 1
        keys = []
        for n, (codes, places) in self.codes.items():
            ends = len(number) - n + 1
            if ends <= 0:
                continue
            code, whole = np.zeros(ends, np.int64), owner[n - 1 :] == owner[:ends]
            for k in range(n):
                code = code * (len(self.words) + 1) + number[k : k + ends]
                whole &= number[k : k + ends] > 0
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = whole & (codes[at] == code)
            keys.append(owner[:ends][hit] * len(self.idf) + places[at[hit]])
        keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        rows, terms = keys // len(self.idf), keys % len(self.idf)
        weights = counts * self.idf[terms]
        return rows, terms, weights / np.sqrt(np.bincount(rows, weights * weights, len(tokens)))[rows]


def _flat(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of word lists, and the row of each."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    return tokens.flatten(), np.repeat(np.arange(len(tokens)), lengths)


def term_statistics(
    df: DataFrame,
    text: str,
    ngram_range: tuple[int, int] = TFIDF_NGRAMS,
    stop_words: Iterable[str] = (),
    only: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(term, tf, df): occurrences in all texts and number of texts with the term.

    Words get numbers inside a batch of texts, n-grams are counted as numbers, and only the sums of a batch are
    spelled out and shuffled. ``only`` tells the words of which n-grams may be made; a null word breaks a run.
    """
    tokens = fn.tokens(text, tuple(stop_words))
    if only is not None:
        tokens = F.transform(tokens, lambda w: F.when(only(w), w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("w")
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))
            at = 0
            while at < len(column):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BATCH_WORDS, "right")))
                yield from _counted(column.slice(at, to - at), ngram_range)
                at = to

    told = df.select(tokens.alias("w")).mapInArrow(run, "term string, tf long, df long")
    return told.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _counted(tokens: pa.Array, ngram_range: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The n-grams of some texts: (term, tf, df) for each length."""
    flat, owner = _flat(tokens)
    coded = flat.dictionary_encode()
    number = np.asarray(pc.fill_null(coded.indices, -1), np.int64)
    base, (low, high) = len(coded.dictionary) + 1, ngram_range
    code, there = number.copy(), number >= 0
    for n in range(1, high + 1):
        if n > 1:
            # the runs so far are numbered anew, so that codes stay small whatever the length
            _, code = np.unique(code, return_inverse=True)
            ends = len(number) - n + 1
            if ends <= 0:
                return
            there = there[:ends] & (number[n - 1 :] >= 0) & (owner[n - 1 :] == owner[:ends])
            code = code[:ends] * base + number[n - 1 :]
        if n < low:
            continue
        starts = np.flatnonzero(there)
        _, first, place, tf = np.unique(code[starts], return_index=True, return_inverse=True, return_counts=True)
        if not len(tf):
            continue
        # a text counts once for a term
        both = np.unique(owner[starts] * len(tf) + place)
        df = np.bincount(both % len(tf), minlength=len(tf))
        parts = [coded.dictionary.take(pa.array(number[starts[first] + k])) for k in range(n)]
        terms = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        yield pa.RecordBatch.from_arrays([terms, pa.array(tf), pa.array(df)], ["term", "tf", "df"])


def vocabulary(
    statistics: DataFrame,
    n_texts: int,
    max_features: int = TFIDF_MAX_FEATURES,
    min_df: int = TFIDF_MIN_DF,
    max_df: float = TFIDF_MAX_DF,
) -> DataFrame:
    """The most frequent terms that occur in enough texts but not in too many."""
    if max_features <= 0:
        raise ValueError("max_features must be positive")
    usable = statistics.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_texts))
    idf = F.log(F.lit(1.0 + n_texts) / (F.col("df") + 1)) + 1
    return (
        usable.orderBy(F.desc("tf"), "term").limit(max_features).select("term", "tf", "df", idf.alias("idf"))
    )


def fit_tfidf(
    df: DataFrame,
    text: str,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
    max_features: int = TFIDF_MAX_FEATURES,
    ngram_range: tuple[int, int] = TFIDF_NGRAMS,
    min_df: int = TFIDF_MIN_DF,
    max_df: float = TFIDF_MAX_DF,
) -> TfidfModel:
    """Count the corpus and keep the ``max_features`` terms.

    Single words are counted first. An n-gram is no more frequent than its rarest word, so only
    words as frequent as the last single word on the list can be part of one that makes it. Runs
    with any other word are not even built, and the result is the same.
    """
    low, high = ngram_range
    stop = tuple(stop_words)
    present = df.filter(as_column(text).isNotNull())
    n_texts = present.count()
    single = term_statistics(present, text, (1, 1), stop).persist()
    try:
        parts = [single] if low == 1 else []
        if high > 1:
            kept = _frequent_words(single, n_texts, max_features if low == 1 else 0, min_df, max_df)
            parts.append(term_statistics(present, text, (max(low, 2), high), stop, kept))
        statistics = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        chosen = vocabulary(statistics, n_texts, max_features, min_df, max_df)
        rows = sorted((r["term"], r["idf"]) for r in chosen.collect())  # max_features rows
    finally:
        single.unpersist()
    return TfidfModel([t for t, _ in rows], [w for _, w in rows], ngram_range, stop)


def _frequent_words(
    single: DataFrame, n_texts: int, max_features: int, min_df: int, max_df: float
) -> Callable[[Column], Column]:
    """Whether a word may be part of a chosen n-gram."""
    least = min_df
    if max_features:
        best = vocabulary(single, n_texts, max_features, min_df, max_df)
        last = best.agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
        if last["n"] == max_features:
            least = last["tf"]
    return sieve(single.filter(F.col("tf") >= least).select("term"))


def _with_grams(
    df: DataFrame,
    text: str,
    ngram_range: tuple[int, int],
    stop_words: tuple[str, ...],
    only: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds the n-grams; with ``only``, those made of words that pass it."""
    words = df.withColumn("__words", fn.tokens(text, stop_words))
    if only is not None:
        listed = F.transform("__words", lambda w: F.when(only(w), w))
        words = words.withColumn("__words", listed)
    return words.withColumn("__grams", fn.ngrams("__words", *ngram_range))
