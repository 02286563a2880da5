"""MinHash fingerprints of documents.

A text's shingles of five words are hashed, and many universal hash permutations (multiply, add, keep
the high bits) run over all shingles of a block of texts in numpy; the smallest value of each is one place of
the fingerprint. Equal places estimate the Jaccard similarity. Bands of places are joined in Spark to find
near copies, which the Jaccard join's exact comparison then verifies. Only texts that share a band are shuffled for
that; what was found travels to the fingerprints along with the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.jaccard import jaccard_groups, set_digests, set_groups
from tagloom.llm.shared import blocks, mix, shingle_sets, shingles, words

PERMUTATIONS, LENGTH = 128, 5
#: Bands and places in a band: two texts alike by 0.8 share a band with probability 0.99995.
BANDS, PLACES = 25, 5
#: Bytes of text that are fingerprinted together, so that their hashes stay in the processor's cache.
TOGETHER = 1 << 19
#: The place of a text without words.
NOTHING = np.uint32(0xFFFFFFFF)
_RANDOM = np.random.default_rng(20250115)
FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minima(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of each permutation over each stretch of hashes: a row per stretch."""
    out = np.full((len(begins) - 1, PERMUTATIONS), NOTHING, np.uint32)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[full]
        room = np.empty_like(found)
        for k in range(PERMUTATIONS):
            np.multiply(found, FACTORS[k], out=room)
            np.add(room, TERMS[k], out=room)
            out[full, k] = (np.minimum.reduceat(room, at) >> np.uint64(32)).astype(np.uint32)
    return out


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, _, _, first = words(pa.array(texts, pa.large_string()))
    return shingles(codes, first, LENGTH)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts, a row each; a text without words has only the largest value."""
    return minima(*_shingles(texts))


def fingerprints_of_both(texts: list[str], edited: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts and of their edited forms; shingles at both beginnings are worked through once."""
    (a, a_at), (b, b_at) = _shingles(texts), _shingles(edited)
    parts, sizes = [], []
    for i in range(len(texts)):
        x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        same = int(differ[0]) if len(differ) else n
        parts += [x[:same], x[same:], y[same:]]
        sizes += [same, len(x) - same, len(y) - same]
    found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    three = minima(found, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])).reshape(len(texts), 3, PERMUTATIONS)
    return np.minimum(three[:, 0], three[:, 1]), np.minimum(three[:, 0], three[:, 2])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of the places in which fingerprints agree, the estimate of the Jaccard similarity."""
    return (a == b).mean(1)


def written(prints: np.ndarray) -> list[str]:
    """Fingerprints as lower-case hex digits, eight for each place."""
    return [row.tobytes().hex() for row in prints.astype(">u4")]


def edit(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _neighbours(docs: DataFrame, n: int, links: DataFrame | None) -> DataFrame:
    """Documents in ``n`` ranges of ids, each range with the first document of the next as a row with ahead = 1.

    ``links`` (doc_id, set, n_links, component_id) adds its rows, which have no text, to the ranges of their ids.
    The driver sees a bounded number of range borders and first ids; texts are shuffled once.
    """
    low = -(1 << 63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(low)).alias("key"))
    marks = keyed.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
    marks = sorted(set(marks))
    borders = F.array(*[F.lit(m).cast("long") for m in marks]) if marks else F.array().cast("array<bigint>")
    place = F.size(F.filter(borders, lambda b: b < F.col("key")))
    placed = keyed.withColumn("range", place)
    heads = sorted((r["range"], r["first"]) for r in placed.groupBy("range").agg(F.min("key").alias("first")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    nothing = [F.lit(None).cast("long").alias(c) for c in ("set", "n_links", "component_id")]
    if not before:
        return placed.select("*", F.lit(0).alias("ahead"), *nothing)
    # The first document of all follows the last one.
    also = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    is_first = F.col("key").isin(list(before))
    twice = F.when(
        is_first,
        F.array(
            F.struct(F.col("range"), F.lit(0).alias("ahead")),
            F.struct(F.element_at(also, F.col("key")).alias("range"), F.lit(1).alias("ahead")),
        ),
    ).otherwise(F.array(F.struct(F.col("range"), F.lit(0).alias("ahead"))))
    rows = placed.withColumn("at", F.explode(twice)).select("doc_id", "text", "key", "at.range", "at.ahead", *nothing)
    if links is None:
        return rows
    also = links.withColumn("key", F.col("doc_id")).withColumn("range", place)
    return rows.union(
        also.select("doc_id", F.lit(None).cast("string"), "key", "range", F.lit(0), "set", "n_links", "component_id")
    )


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last document, until the next is known
    done = None  # a range whose following document was seen
    links: tuple = (None, {})  # a document and its links by set; they come before its texts

    for block in blocks(batches, "text", TOGETHER):
        ids, texts = block.column("doc_id").to_pylist(), block.column("text").to_pylist()
        ranges, ahead = block.column("range").to_pylist(), block.column("ahead").to_pylist()
        found = zip(*[block.column(c).to_pylist() for c in ("set", "n_links", "component_id")], strict=True)
        own: list[tuple] = []  # (doc_id, text, links, following)
        for i, text, part, extra, (digest, *link) in zip(ids, texts, ranges, ahead, found, strict=True):
            if text is None:
                if links[0] != i:
                    links = (i, {})
                links[1][digest] = link
                continue
            if done == part and extra:
                continue
            if held is not None:
                own.append((*held, text))
            held = None if extra else (i, text, links[1] if i is not None and links[0] == i else {})
            done = part if extra else None
        if own:
            yield _rows(own)
    if held is not None:
        raise RuntimeError("a range lacks the document that follows it")


def _rows(own: list[tuple]) -> pa.RecordBatch:
    texts, following = [r[1] for r in own], [r[3] for r in own]
    changed = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    prints, edited = fingerprints_of_both(texts, changed)
    # Most documents' following one is the next row.
    next_prints = np.empty_like(prints)
    lone = [k for k in range(len(own)) if k + 1 == len(own) or following[k] is not texts[k + 1]]
    rest = np.setdiff1d(np.arange(len(own)), lone)
    next_prints[rest] = prints[rest + 1]
    next_prints[lone] = fingerprints([following[k] for k in lone])
    # Rows of one id may have different texts, so links go by the text's set as well.
    links = [[0, r[0]] for r in own]
    some = [k for k, r in enumerate(own) if r[2]]
    if some:
        codes, _, _, first = words(pa.array([texts[k] for k in some], pa.large_string()), fold=True)
        digests = set_digests(*shingle_sets(codes, first, LENGTH)).view(np.int64).tolist()
        for k, digest in zip(some, digests, strict=True):
            links[k] = own[k][2].get(digest, links[k])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in own], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(written(prints)),
            pa.array(written(edited)),
            pa.array(likeness(prints, edited)),
            pa.array(likeness(prints, next_prints)),
            pa.array([n for n, _ in links], pa.int64()),
            pa.array([c for _, c in links], pa.int64()),
        ],
        [
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
            "n_links", "component_id",
        ],
    )


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of texts edited with the next document, by ascending doc_id.

    Returns a row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty; texts without words are alike by 1. Of equal ids the smaller
    text comes first, a null id before all others; the last document is followed by the first, a single
    one by itself. Other columns are ignored; an empty table gives no rows.
    """
    return _with_links(docs, None, ranges).drop("n_links", "component_id")


def linked_fingerprints(docs: DataFrame, percent: int = 80, ranges: int | None = None) -> DataFrame:
    """:func:`edited_fingerprints` with n_links and component_id, what :func:`near_copies` says of the row.

    A document that is alike by ``percent`` to no other has no links and its own id as component_id; so
    has a text without words. A null doc_id has no links and no component_id.
    """
    found = set_groups(docs, LENGTH, percent, keys=band_keys(docs.filter("doc_id is not null")))
    links = found.filter("n_links > 0").select("doc_id", "set", "n_links", "component_id").distinct()
    return _with_links(docs, links, ranges)


def _with_links(docs: DataFrame, links: DataFrame | None, ranges: int | None) -> DataFrame:
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _neighbours(docs, n, links)
    # Links have no text and so come before the texts of their id.
    dealt = placed.repartition("range").sortWithinPartitions("range", "ahead", "key", "text")
    return dealt.mapInArrow(
        _fingerprint,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "n_links long, component_id long",
    )


def band_keys(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row (key, set) for each band of each text's fingerprint; set is the hash of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TOGETHER):
            codes, _, _, first = words(block.column("text"), fold=True)
            found, begins = shingle_sets(codes, first, length)
            digests = set_digests(found, begins)
            _, one = np.unique(digests, return_index=True)
            some = one[np.diff(begins)[one] > 0]
            bands = minima(found, begins)[some, : BANDS * PLACES].reshape(len(some), BANDS, PLACES).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(some), 1), np.uint64)
            for k in range(PLACES):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
            sets = np.repeat(digests[some], BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)) for x in (key, sets)], ["key", "set"])

    return docs.select("text").mapInArrow(run, "key long, set long")


def near_copies(docs: DataFrame, length: int = LENGTH, percent: int = 80) -> DataFrame:
    """Groups of near copies: doc_id, n_shingles, n_links, component_id, as the Jaccard join gives them.

    Candidates share a band of their fingerprints, or are joined by others that do; every link is
    verified on the whole sets. A link of similarity 0.8 is missed with probability 0.00005.
    """
    return jaccard_groups(docs, length, percent, keys=band_keys(docs.filter("doc_id is not null"), length))
