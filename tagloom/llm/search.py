"""Ranked lexical search, a term at a time with few accumulators.

Texts are indexed in blocks: a block holds, for each term that some query has, the places of its texts and how often
they hold it. A query takes its terms rarest first and adds each posting to its text's accumulator. The greatest
share that a term can add in a block is known, so as soon as what the remaining terms can add together is less than
the k-th best score so far, no further text can come in: no accumulators are created from then on, those that
can't reach the k-th either are given up, and the others are looked up in the remaining postings, which makes
their scores exact.

A block is one row, so it never lies in two tasks. Each task keeps the best of its blocks and passes on ``k`` rows a query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagloom.llm.shared import blocks, small_batches, stored, words

#: Texts and postings of an index block.
TEXTS, POSTINGS = 1 << 15, 1 << 20
#: Queries that are answered together, and their terms; more queries are answered in further passes.
QUERIES, TERMS = 1 << 12, 1 << 18
#: Saturation and length of the score, and its unit: fixed values.
K1, SHORT, LONG, UNIT = 1000, 25, 75, 10**9
LAST = np.iinfo(np.int64).max

#: Bytes outside terms: ASCII but for digits and letters. All bytes of other characters belong to terms.
GAPS = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    GAPS[_low:_high] = False

INDEX = "ids array<long>, sizes binary, terms binary, starts binary, places binary, counts binary, n_texts long, n_terms long"


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of each text in order, and the number of terms before each text."""
    codes, _, _, first = words(texts, fold=True, gaps=GAPS)
    return codes, first


class _Block:
    """Postings that are gathered for one index row."""

    def __init__(self):
        self.ids, self.sizes, self.keys, self.counts = [], [], [], []
        self.texts = self.postings = self.n_texts = self.n_terms = 0

    def add(self, ids: pa.Array, sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        used, place = np.unique(owner, return_inverse=True)
        self.ids.append(ids.take(pa.array(used)))
        self.sizes.append(sizes[used])
        self.keys.append((term << 32) | (place + self.texts))
        self.counts.append(count)
        self.texts, self.postings = self.texts + len(used), self.postings + len(count)
        self.n_texts, self.n_terms = self.n_texts + int((sizes > 0).sum()), self.n_terms + int(sizes.sum())

    def row(self) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        term, places = keys[order] >> 32, keys[order] & 0xFFFFFFFF
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        packed = [np.concatenate(self.sizes), term[starts], np.append(starts, len(term)), places, counts[order]]
        ids = pa.concat_arrays(self.ids).cast(pa.int64())
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        columns += [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in packed]
        columns += [pa.array([n], pa.int64()) for n in (self.n_texts, self.n_terms)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, vocabulary: np.ndarray, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Index rows of all texts for the terms whose hashes are in ``vocabulary`` (ascending).

    n_texts and n_terms count all texts with a term, and all their terms.
    """
    most_texts, most_postings = TEXTS, POSTINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for part in blocks(batches, "text"):
            codes, first = term_codes(part.column("text"))
            term = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
            listed = vocabulary[term] == codes
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            keys, counts = np.unique(owner[listed] * len(vocabulary) + term[listed], return_counts=True)
            block.add(part.column("id"), np.diff(first), keys // len(vocabulary), keys % len(vocabulary), counts)
            if block.texts >= most_texts or block.postings >= most_postings:
                yield block.row()
                block = _Block()
        if block.ids:
            yield block.row()

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("text"))
    return texts.mapInArrow(run, INDEX)


def frequencies(indexed: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """How many texts hold each of the terms, how many hold any term, and the number of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = np.zeros(terms, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                held[np.frombuffer(row["terms"], np.int32)] += np.diff(np.frombuffer(row["starts"], np.int32))
                totals += (row["n_texts"], row["n_terms"])
        some = np.flatnonzero(held)
        values = np.concatenate([held[some], totals])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, (-1, -2))), pa.array(values)], ["term", "n"])

    told = indexed.select("terms", "starts", "n_texts", "n_terms").mapInArrow(run, "term long, n long")
    # A row for each term of the queries that are answered together.
    sums = {r["term"]: r["n"] for r in told.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    held = np.zeros(terms, np.int64)
    for term, n in sums.items():
        if term >= 0:
            held[term] = n
    return held, sums.get(-1, 0), sums.get(-2, 0)


class Top:
    """The ``k`` best (score, id) of a query; of equal scores the smallest id counts, a null id last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a text must reach to get in: the k-th best score, or 1."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Shard:
    """An index block that is ready to be searched."""

    def __init__(self, row: dict, texts: int, terms: int, vocabulary: int):
        sizes, self.terms, self.starts, self.places, counts = (
            np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("sizes", "terms", "starts", "places", "counts")
        )
        self.known = np.array([x is not None for x in row["ids"]], bool)
        self.ids = np.array([LAST if x is None else x for x in row["ids"]], np.int64)
        spread = SHORT + (LONG * sizes * texts) // max(1, terms)
        self.share = (UNIT * counts) // (K1 * counts + 8 * spread[self.places])
        self.slot = np.full(vocabulary, -1, np.int64)
        self.slot[self.terms] = np.arange(len(self.terms))
        self.most = np.maximum.reduceat(self.share, self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: Top, k: int) -> int:
        """Add this block's best texts to ``top``; terms come rarest first. Returns the accumulators created."""
        slots = self.slot[terms]
        held = slots >= 0
        slots, weights = slots[held], weights[held]
        bounds = weights * self.most[slots]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        if rest[0] < top.least():
            return 0
        totals = np.zeros(len(self.ids), np.int64)
        best = 0  # the k-th score when last looked at; it grows by no more than the bounds of the terms since
        since = done = 0
        for i, slot in enumerate(slots):
            here = slice(self.starts[slot], self.starts[slot + 1])
            totals[self.places[here]] += weights[i] * self.share[here]
            done, since = i + 1, since + bounds[i]
            if rest[done] < top.least():
                break
            if rest[done] and best + since > rest[done]:
                best, since = _kth(totals, k), 0
                if rest[done] < best:
                    break
        alive = np.flatnonzero(totals)
        created, scores = len(alive), totals[alive]
        # from here on only the texts that have an accumulator, without those that can't reach the k-th
        for i in range(done, len(slots)):
            reach = scores + rest[i] >= max(top.least(), _kth(scores, k))
            alive, scores = alive[reach], scores[reach]
            here = slice(self.starts[slots[i]], self.starts[slots[i] + 1])
            places = self.places[here]
            at = np.minimum(np.searchsorted(places, alive), len(places) - 1)
            scores += np.where(places[at] == alive, weights[i] * self.share[here][at], 0)
        fit = scores >= max(1, top.least(), _kth(scores, k))
        alive = alive[fit]
        top.add(scores[fit], self.ids[alive], self.known[alive])
        return created


def _parts(queries: DataFrame) -> Iterator[list]:
    """Queries in lists of bounded size, read one partition at a time."""
    rows, terms = [], 0
    for row in queries.toLocalIterator():
        found = Counter(re.findall("[0-9a-z\x80-\U0010ffff]+", (row["text"] or "").translate(_LOWER)))
        if rows and (len(rows) >= QUERIES or terms + len(found) > TERMS):
            yield rows
            rows, terms = [], 0
        if found:
            rows.append((row["id"], found))
            terms += len(found)
    if rows:
        yield rows


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _answer(docs: DataFrame, rows: list, k: int, out: StructType, id_column: str, column: str) -> DataFrame:
    names = sorted({t for _, found in rows for t in found})
    codes, first = term_codes(pa.array(names))
    order = np.argsort(codes)
    vocabulary, place = codes[order], np.argsort(order)
    assert (np.diff(first) == 1).all()
    indexed = stored(index(docs, vocabulary, id_column, column), "search-index")
    held, texts, total = frequencies(indexed, len(vocabulary))
    # the weight of each term, in doubles
    weight = np.floor(1000 * np.log((2 * texts + 2) / (2 * held + 1))).astype(np.int64)
    number = dict(zip(names, place.tolist(), strict=True))
    asked = []
    for _, found in rows:
        terms = np.array([number[t] for t in found], np.int64)
        weights = weight[terms] * np.array(list(found.values()), np.int64)
        rare = np.lexsort((terms, held[terms]))
        rare = rare[(weights > 0)[rare]]
        asked.append((terms[rare], weights[rare]))
    ids = [i for i, _ in rows]
    schema = StructType([StructField("query", IntegerType()), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, texts, total, len(vocabulary))
                for (terms, weights), top in zip(asked, tops, strict=True):
                    shard.search(terms, weights, top, k)
        numbers = np.repeat(np.arange(len(tops), dtype=np.int32), [len(t.ids) for t in tops])
        if len(numbers):
            found, known, scores = (np.concatenate([getattr(t, x) for t in tops]) for x in ("ids", "known", "scores"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), pa.array([ids[i] for i in numbers], pa.int64()), pa.array(found, pa.int64(), mask=~known), pa.array(scores)],
                schema.names,
            )

    best = indexed.select("ids", "sizes", "terms", "starts", "places", "counts").mapInArrow(run, schema)
    # k rows of each task and query; ranked as the numbers of the queries are dealt, a part of them before the shuffle.
    last = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last(out.names[1]))
    ranked = best.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select(out.names[0], "rank", *out.names[1:])


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    query_id: str = "item_id",
    column: str = "text",
) -> DataFrame:
    """The ``k`` best texts of each query: query id, rank (from 1), document id and score.

    Terms are runs of ASCII letters (A-Z as a-z), ASCII digits and all other characters beyond ASCII; they are compared by 64-bit
    hashes. The score sums, over the terms of the query with repeats, the term's weight times its saturated number in
    the text, in whole numbers. Only scores above 0 count; of equal ones the smallest document id comes first, null
    ids last. Null and empty texts have no term and are counted nowhere. Every row is a text or a query of its
    own, also when its id occurs again or is null. Without texts or queries the result is empty. Both ids
    are whole numbers.

    Queries come to the driver in lists of bounded size; for each list the texts are read once.
    """
    spark = small_batches(docs.sparkSession)
    out = StructType.fromDDL(f"`{query_id}` long, `{doc_id}` long, score long")
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(column).alias("text"))
    answers = [_answer(docs, rows, k, out, doc_id, column) for rows in _parts(asked)]
    if not answers:
        none = StructType([out.fields[0], StructField("rank", IntegerType()), *out.fields[1:]])
        return spark.createDataFrame([], none)
    return reduce(DataFrame.union, answers)

