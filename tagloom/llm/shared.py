"""Parts that several operators share: cutting lineage, blocks of texts, word hashes, shared keys."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import scratch_path

BLOCK_BYTES = 1 << 20
#: Digits of a number within a part of a sieve (8 KB).
SIEVE_PART = 16
#: Members of a key are counted up to this number.
MOST_MEMBERS = 1 << 18
_RANDOM = np.random.default_rng(20240607)
#: A random 64-bit number for each byte, and for each byte with A-Z in lower case.
BYTE_CODES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session, for sessions that were started without it."""
    context = spark.sparkContext
    if getattr(context, "_tagloom_shipped", None) is None:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="tagloom-"), "tagloom")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        context._tagloom_shipped = True
    return spark


def small_batches(spark: SparkSession, rows: int = 2_000) -> SparkSession:
    """Pass whole texts to Python in smaller batches than Spark's default, unless the session has its own size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return spark


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES, 1 << max(1, n - 1).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b)])) for b in (BASE, BASE_INVERSE)
            )
    return _POWERS[size]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, and where each begins (one more at the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(
    texts: pa.Array, fold: bool = False, gaps: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the number of words before each text.

    Words are runs of bytes other than ``gaps`` (a flag for each byte): space, tab, line feed, vertical tab, form
    feed and carriage return. The hash is a polynomial over random byte codes, taken from running sums, so a block
    of texts costs a few passes over its bytes. ``fold`` counts A-Z as a-z.
    """
    raw, offsets = text_bytes(texts)
    solid = ~gaps[raw]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((FOLDED_CODES if fold else BYTE_CODES)[raw] * up[: len(raw)], out=sums[1:])
    codes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return codes, starts, ends, first


def sequences(codes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` consecutive words, whichever text they stand in."""
    n = max(0, len(codes) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += codes[k : k + n] * PLACE[k]
    return mix(total + np.uint64(length))


def shingles(codes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``length`` words of each text, in order, and the number before each text.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    counts = np.diff(first)
    own = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(own)])
    place = np.arange(begins[-1]) - np.repeat(begins[:-1], own) + np.repeat(first[:-1], own)
    whole = sequences(np.concatenate([codes, np.zeros(length, np.uint64)]), length)
    out = whole[place]
    for i in np.flatnonzero((counts > 0) & (counts < length)):
        part = codes[first[i] : first[i + 1]]
        out[begins[i]] = mix(np.sum(part * PLACE[: len(part)], dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
    return out, begins


def shingle_sets(codes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, and the number before each text."""
    found, begins = shingles(codes, first, length)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(begins))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(first)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = hub = last = None
    for batch in batches:
        k, m = (np.asarray(batch.column(c)) for c in (0, 1))
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        heads = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        hubs = np.where(run >= 0, m[heads][np.maximum(run, 0)] if len(heads) else hub, hub if hub is not None else 0)
        keep = ~new
        keep[1:] &= (m[1:] != m[:-1]) | new[1:]
        keep[0] &= m[0] != last
        keep &= m != hubs
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, hubs, m)], ["key", "hub", "member"])
        key, hub, last = k[-1], hubs[-1], m[-1]


def sieve(numbers: DataFrame, most: int) -> Broadcast:
    """A bit for the last binary digits of each number (one long column, without nulls), for all tasks.

    There are about 16 bits for each number, but never more than ``2 ** most``. The more numbers there are
    beyond that, the more others pass too, so what follows must not depend on them.
    """
    bits = min(most, max(SIEVE_PART, int(16 * numbers.count()).bit_length()))
    number = F.col(numbers.columns[0]).bitwiseAND((1 << bits) - 1)
    part = F.shiftright("number", SIEVE_PART).alias("part")
    dealt = numbers.select(number.alias("number")).distinct().select(part, "number").repartition("part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, numbers = (np.asarray(batch.column(c)) for c in (0, 1))
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            rows = []
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    here = np.zeros(1 << SIEVE_PART, bool)
                    here[numbers[a:b] & ((1 << SIEVE_PART) - 1)] = True
                    rows.append((int(parts[a]), np.packbits(here, bitorder="little").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["part", "set"])

    table = np.zeros((1 << (bits - SIEVE_PART), 1 << (SIEVE_PART - 3)), np.uint8)
    for row in dealt.mapInArrow(run, "part long, set binary").toLocalIterator():
        table[row["part"]] |= np.frombuffer(row["set"], np.uint8)
    return numbers.sparkSession.sparkContext.broadcast(table.ravel().view(np.uint64))


def passes(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned numbers passes a sieve."""
    number = numbers & np.uint64(64 * len(table) - 1)
    return (table[(number >> np.uint64(6)).astype(np.int64)] >> (number & np.uint64(63))) & np.uint64(1) == 1


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that several members have: a row (key, hub, member) for each member but the smallest, the hub.

    ``rows`` has two long columns, key and member, without nulls. Rows are sorted by Spark and read
    as a stream, so a key with any number of members needs no memory; repeated rows count once.
    """
    key, member = rows.columns
    dealt = rows.repartition(key).sortWithinPartitions(key, member)
    return dealt.mapInArrow(_shared, "key long, hub long, member long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None  # key and member of the last row
    held: list[list[np.ndarray]] = []  # the last key's rows that wait for its number
    waiting = passed = 0  # how many these are, and how many went on before them

    def out(rows: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        keep = n > 1
        return pa.RecordBatch.from_arrays([pa.array(r[keep]) for r in (*rows, n)], ["key", "member", "more", "n"])

    def whole() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        rows = [np.asarray(batch.column(c)) for c in range(3)]
        if not len(rows[0]):
            continue
        same = np.zeros(len(rows[0]), bool)
        same[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        same[0] = last == (rows[0][0], rows[1][0])
        before, last = last, (rows[0][-1], rows[1][-1])
        rows = [r[~same] for r in rows]
        if not len(rows[0]):
            continue
        goes_on = before is not None and before[0] == rows[0][0]
        edges = [0, *(np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1), len(rows[0])]
        if held and (not goes_on or len(edges) > 2):
            # The key that waits ends here.
            first = edges[1] if goes_on else 0
            held.append([r[:first] for r in rows])
            yield out(whole(), np.full(waiting + first, min(waiting + first + passed, MOST_MEMBERS), np.int64))
            rows, edges = [r[first:] for r in rows], [e - first for e in (edges[1:] if goes_on else edges)]
            held, waiting, passed, goes_on = [], 0, 0, False
        if not goes_on:
            passed = 0
        counts = np.diff(edges)
        if len(counts) > 1:
            counts[0] += passed
            n = np.repeat(np.minimum(counts[:-1], MOST_MEMBERS), np.diff(edges)[:-1])
            yield out([r[: edges[-2]] for r in rows], n)
            passed = 0
        held.append([r[edges[-2] :] for r in rows])
        waiting += len(held[-1][0])
        if waiting + passed >= MOST_MEMBERS:
            yield out(whole(), np.full(waiting, MOST_MEMBERS, np.int64))
            held, waiting, passed = [], 0, MOST_MEMBERS
    if held:
        yield out(whole(), np.full(waiting, min(waiting + passed, MOST_MEMBERS), np.int64))


def met_keys(rows: DataFrame, number: str | None = None) -> DataFrame:
    """The rows (key, member, more) of keys that several members have, each member once for a key.

    ``rows`` has three long columns without nulls, and equal members of a key have the same third. ``number``
    names a further column: how many members the key has, or ``MOST_MEMBERS`` if there are more. Rows are
    sorted by Spark and read as a stream that holds so many of a key at most, so a key can have any number of members.
    """
    key, member, _ = rows.columns
    dealt = rows.repartition(key).sortWithinPartitions(key, member)
    met = dealt.mapInArrow(_met, "key long, member long, more long, n long")
    return met.withColumnRenamed("n", number) if number else met.drop("n")
