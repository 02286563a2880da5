"""Substring dedup with FM-indexes: removes passages that stand in an earlier document.

Windows of words are routed by their anchor, the least hash of the short word runs inside them, so equal
windows always meet in one shard; anchors that only one document has lead nowhere and are left out. A
shard's different segments form an FM-index (a Burrows-Wheeler transform in a wavelet matrix of packed bits),
through which the segments of all documents are streamed: backward search from every position, word by word,
gives the length of the match, up to the threshold, and where it occurs; the smallest document there
decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import blocks, mix, passes, sequences, shared_keys, sieve, stored, words

WINDOW, ANCHOR = 13, 5
#: Most windows in a segment.
LONGEST = 64
#: An anchor that so many documents have is split: each of its windows is routed by its own hash.
HOT = 500
#: Bodies that a task remembers.
KEPT_BODIES = 200_000
#: Words of the segments that are indexed together.
SHARD_WORDS = 1 << 19
#: The sieves of anchors and of documents have 2 to this power bits at most (32 MB).
SIEVE_BITS = 28


class WaveletMatrix:
    """Occurrences of symbols before a place of a sequence, from packed bits of one level per binary digit."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        low = self.bits[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` of the sequence comes to lie on the last level among ``symbols``."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of segments of symbols (0 and up) for backward search of runs of at most ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, depth: int = 16):
        # 0 is the mark after each segment.
        sizes = np.diff(begins)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        text = np.zeros(len(symbols) + len(sizes), np.int64)
        self.place = np.arange(len(symbols)) + owner
        text[self.place] = symbols + 1
        self.text = text
        self.segment = np.repeat(np.arange(len(sizes)), sizes + 1)
        n = len(text)
        # Suffixes in the order of their first symbols, by doubling as far as searches go.
        rank, reach = text, 1
        while reach < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - reach)] = rank[reach:] + 1
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1]
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        last = text[self.order - 1]
        kinds = int(text.max(initial=0)) + 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.matrix = WaveletMatrix(last, max(1, (kinds - 1).bit_length()))
        every = np.arange(kinds)
        self.base = self.matrix.descend(every, np.zeros(kinds, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with a symbol followed by what each range has in common."""
        add = self.start[symbols] - self.base[symbols]
        return add + self.matrix.descend(symbols, low), add + self.matrix.descend(symbols, high)

    def matches(self, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``threshold`` symbols from each place ``at`` of the indexed text, last symbol first:
        the lengths of the matches, and the range of suffixes that match wholly."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.text), np.int64)
        length = np.zeros(len(at), np.int64)
        for k in range(threshold - 1, -1, -1):
            low, high = self.extend(self.text[at + k], low, high)
            length += high > low
        return length, low, high


def first_occurrences(bodies: list[np.ndarray], documents: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each body of words, the smallest of the documents of the bodies in which it stands."""
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    symbols = np.unique(np.concatenate(bodies), return_inverse=True)[1]
    index = FMIndex(symbols, begins, window)
    counts = np.maximum(0, np.diff(begins) - window + 1)
    at = np.repeat(begins[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    length, low, high = index.matches(index.place[at], window)
    # Ranges of whole matches are equal or disjoint, and none is empty: every window stands at least where it was taken.
    heads, which = np.unique(low, return_inverse=True)
    owner = documents[index.segment[index.order]]
    ends = np.zeros(len(heads), np.int64)
    ends[which] = high
    edges = np.stack([heads, ends], 1).ravel()
    least = np.minimum.reduceat(np.append(owner, owner.max(initial=0)), edges)[::2] if len(heads) else owner[:0]
    found = np.where(length == window, least[which], np.iinfo(np.int64).max)
    return np.split(found, np.cumsum(counts)[:-1])


def window_anchors(codes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of each text begins among the words, and its anchor."""
    counts = np.maximum(0, np.diff(first) - window + 1)
    at = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    least = sequences(codes, anchor)
    width, reach = window - anchor + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        reach += step
    return at, least[at]


def anchors_of(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """anchor, doc_id: the anchors of each document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            codes, _, _, first = words(block.column("text"))
            at, found = window_anchors(codes, first, window, anchor)
            new = np.ones(len(at), bool)
            new[1:] = found[1:] != found[:-1]
            owner = np.searchsorted(first, at, "right") - 1
            new[1:] |= owner[1:] != owner[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[new].view(np.int64)), block.column("doc_id").take(pa.array(owner[new]))], ["anchor", "doc_id"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def segments_of(docs: DataFrame, shared: Broadcast, hot: Broadcast, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Segments of documents (doc_id, tag, text) at their shared anchors: route, body_key, doc_id, tag, start, body.

    ``shared`` and ``hot`` are sieves of anchors. A segment is a stretch of windows with one anchor; body holds 32
    bits of the hash of each of its words. Windows of a hot anchor are segments of their own, routed by all
    their words. A body that a task has passed on lately for this or a smaller document is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[int, int] = {}
        for block in blocks(batches, "text"):
            codes, _, _, first = words(block.column("text"))
            ids = np.asarray(block.column("doc_id"))
            at, found = window_anchors(codes, first, window, anchor)
            known = passes(shared.value, found)
            at, found = at[known], found[known]
            if not len(at):
                continue
            owner, split = np.searchsorted(first, at, "right") - 1, passes(hot.value, found)
            new = np.ones(len(at), bool)
            new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | split[1:]
            heads = np.flatnonzero(new)
            place = np.arange(len(at)) - heads[np.cumsum(new) - 1]
            heads = np.flatnonzero(new | (place % LONGEST == 0))
            sizes = np.diff(np.append(heads, len(at)))
            short = (codes >> np.uint64(32)).astype(np.uint32)
            bodies = [short[a : a + n + window - 1].tobytes() for a, n in zip(at[heads], sizes, strict=True)]
            keys = np.array([int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little") for b in bodies], np.uint64)
            route = np.where(split[heads], mix(keys), found[heads])
            rows = pa.array(owner[heads])
            if len(passed) > KEPT_BODIES:
                passed.clear()
            for i, (key, doc) in enumerate(zip(keys.tolist(), ids[owner[heads]].tolist(), strict=True)):
                if passed.get(key, doc + 1) <= doc:
                    bodies[i] = None
                else:
                    passed[key] = doc
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(route.view(np.int64)),
                    pa.array(keys.view(np.int64)),
                    block.column("doc_id").take(rows),
                    block.column("tag").take(rows),
                    pa.array((at[heads] - first[owner[heads]]).astype(np.int32)),
                    pa.array(bodies, pa.binary()),
                ],
                ["route", "body_key", "doc_id", "tag", "start", "body"],
            )

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "route long, body_key long, doc_id long, tag int, start int, body binary")


def _search(window: int):
    def found(rows: list[tuple[np.ndarray, pa.RecordBatch]]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        bodies = [np.frombuffer(b, np.uint32) for b in batch.column("body").to_pylist()]
        firsts = first_occurrences(bodies, np.asarray(batch.column("first")), window)
        sizes = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(firsts)))
        return pa.RecordBatch.from_arrays([batch.column("route"), batch.column("body_key"), lists], ["route", "body_key", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("body_key"))
            new = np.ones(len(keys), bool)
            new[1:], new[0] = keys[1:] != keys[:-1], keys[0] != last
            last = keys[-1]
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            # Shards end where the route changes, once they are large enough.
            route = np.asarray(batch.column("route"))
            lengths = np.diff(np.frombuffer(batch.column("body").buffers()[1], np.int32)[batch.column("body").offset :][: batch.num_rows + 1]) // 4
            at = 0
            edges = np.append(np.flatnonzero(route[1:] != route[:-1]) + 1, batch.num_rows)
            if held and held[-1].column("route")[-1].as_py() != route[0] and size >= SHARD_WORDS:
                yield found(held)
                held, size = [], 0
            total = np.cumsum(lengths)
            for edge in edges[:-1]:
                grown = size + total[edge - 1] - (total[at - 1] if at else 0)
                if grown >= SHARD_WORDS:
                    yield found([*held, batch.slice(at, edge - at)])
                    held, size, at = [], 0, int(edge)
            held.append(batch.slice(at))
            size += int(total[-1] - (total[at - 1] if at else 0))
        if held:
            yield found(held)

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, tag and windows: where windows begin (in words) that also stand in a document of smaller id.

    ``docs`` has doc_id, text and tag, which tells rows of equal id apart; rows with a null doc_id take no part.
    """
    known = docs.filter("doc_id is not null and text is not null")
    met = stored(shared_keys(anchors_of(known, window, anchor)), "anchors")
    often = stored(met.groupBy("key").agg(F.count("*").alias("n")), "anchor-counts")
    shared, hot = sieve(often.select("key"), SIEVE_BITS), sieve(often.filter(F.col("n") >= HOT).select("key"), SIEVE_BITS)
    segments = stored(segments_of(known, shared, hot, window, anchor), "segments")
    # Each task passes on a body for its smallest document, so a body has few rows here, and the first is the least.
    bodies = segments.filter("body is not null").select("route", "body_key", F.col("doc_id").alias("first"), "body")
    dealt = bodies.repartition("route").sortWithinPartitions("route", "body_key", "first")
    firsts = dealt.mapInArrow(_search(window), "route long, body_key long, firsts array<long>").drop("route")
    hits = segments.select("body_key", "doc_id", "tag", "start").join(firsts, "body_key")
    earlier = F.filter(
        F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + i)), lambda at: at.isNotNull()
    )
    return (
        hits.select("doc_id", "tag", earlier.alias("at"))
        .filter(F.size("at") > 0)
        .groupBy("doc_id", "tag")
        .agg(F.flatten(F.collect_list("at")).alias("windows"))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Take out of each text the words of windows that also stand in a document with a smaller doc_id.

    ``docs`` has doc_id and text, other columns are ignored. Returns a row per row: doc_id, n_words, n_removed,
    kept (the words left, joined by one space) and kept_sha256. Words are runs without ASCII white space,
    unchanged; windows are judged on the texts as given. Null and empty texts have no words; rows of equal
    id don't count against each other; rows with a null id lose nothing and take nothing. Words are
    compared by 32 bits of a hash, windows by 13 of them.
    """
    tag = F.pmod(F.xxhash64("text"), F.lit(1 << 15)).cast("int")
    tagged = docs.select("doc_id", "text", tag.alias("tag"))
    found = stored(repeated_windows(tagged, window, anchor), "windows")
    # Texts that lose nothing stay where they are read.
    losing = sieve(found.select("doc_id"), SIEVE_BITS)

    def choose(want: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                held = passes(losing.value, np.asarray(ids.fill_null(0)).view(np.uint64)) & np.asarray(ids.is_valid())
                yield batch.filter(pa.array(held == want))

        return tagged.mapInArrow(run, "doc_id long, text string, tag int")

    joined = choose(True).hint("merge").join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "windows")
    joined = joined.union(choose(False).select("doc_id", "text", F.lit(None).cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = []
            for text, starts in zip(block.column("text").fill_null("").to_pylist(), block.column("windows"), strict=True):
                found = text.encode().split()
                n = len(found)
                if starts.is_valid:
                    at = np.unique(np.asarray(starts.values))
                    change = np.zeros(n + 1, np.int64)
                    change[at] += 1
                    np.subtract.at(change, at + window, 1)
                    found = [w for w, c in zip(found, np.cumsum(change[:-1]), strict=True) if not c]
                kept = b" ".join(found)
                rows.append((n, n - len(found), kept.decode(), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
