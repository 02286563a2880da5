"""Vector codes: each of the equal parts of a vector is replaced by the nearest entry of that part's codebook.

The different parts of a block of vectors, sorted, form a lexicographic trie: a node is a common prefix of parts,
its children are the values of the next component. The trie is traversed depth first; a node holds its distance to
every entry over its prefix, so parts with a common prefix work it out once. At the leaves the nearest entry
is taken, and each leaf adds its part to that entry's sum as often as the part occurs.

All numbers are integers, so codes do not depend on how the table is cut into tasks. No vector is shuffled:
a round of training sends one row of sums for each entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tagloom.llm.shared import stored

#: Parts of a vector, entries of a codebook, rounds of training, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of the vectors that share a trie, and most leaves that are expanded at once.
BLOCK, LEAVES = 1 << 21, 1 << 11
#: Integers stay within this, so that no sum of squares leaves 64 bits.
LIMIT = 1 << 26
#: Labels (and bytes of them) up to which their sums are broadcast.
LABELS, LABEL_BYTES = 100_000, 1 << 23


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has components, all of them finite."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & fine)


def integers(column: pa.Array, dimensions: int, parts: int) -> np.ndarray:
    """floor(256 * x) of an Arrow column of vectors: vector, part, place in the part (zeros fill the last part)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    whole = np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)
    spare = -dimensions % parts
    if spare:
        whole = np.pad(whole, ((0, 0), (0, spare)))
    return whole.reshape(len(whole), parts, -1)


class Trie:
    """The different rows of a matrix as a trie; ``rows`` holds its leaves in order, ``leaf`` the leaf of each row."""

    def __init__(self, parts: np.ndarray):
        order = np.lexsort(parts.T[::-1])
        ordered = parts[order]
        # opens[d]: rows whose first d + 1 components differ from those of the row before
        opens = np.ones(parts.shape[::-1], bool)
        opens[:, 1:] = np.logical_or.accumulate((ordered[1:] != ordered[:-1]).T, axis=0)
        first = opens[-1]
        self.rows, self.opens = ordered[first], opens[:, first]
        self.leaf = np.empty(len(parts), np.int64)
        self.leaf[order] = np.cumsum(first) - 1
        self.counts = np.bincount(self.leaf, minlength=len(self.rows))

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each leaf (of equal ones the first) and its squared distance."""
        best, error = np.empty(len(self.rows), np.int64), np.empty(len(self.rows), np.int64)
        # what is left to visit: leaves from, to, the depth of the node, its distances to the entries
        stack = [(0, len(self.rows), 0, np.zeros(len(entries), np.int64))]
        while stack:
            start, end, depth, above = stack.pop()
            heads = start + np.flatnonzero(self.opens[depth, start:end])
            if end - start <= LEAVES:
                self._expand(entries, start, end, depth, above, best, error)
            elif depth == self.rows.shape[1] - 1:
                # the children are leaves; distances for some thousand of them at a time
                for at in range(start, end, LEAVES):
                    self._expand(entries, at, min(end, at + LEAVES), depth, above, best, error)
            else:
                edges = np.append(heads, end)
                at = 0
                while at < len(heads):
                    # neighbouring small children share a step, a large one is descended into
                    to = max(at + 1, int(np.searchsorted(edges, edges[at] + LEAVES, "right")) - 1)
                    if to > at + 1 or edges[at + 1] - edges[at] <= LEAVES:
                        self._expand(entries, edges[at], edges[to], depth, above, best, error)
                    else:
                        apart = self.rows[edges[at], depth] - entries[:, depth]
                        stack.append((edges[at], edges[to], depth + 1, above + apart * apart))
                    at = to
        return best, error

    def _expand(self, entries, start, end, depth, above, best, error) -> None:
        """All of the trie below a node between two leaves, level by level, a row of distances for each prefix."""
        total, last = above[None, :], np.zeros(end - start, np.int64)
        for d in range(depth, self.rows.shape[1]):
            new = self.opens[d, start:end].copy()
            new[0] = True
            heads = np.flatnonzero(new)
            apart = self.rows[start + heads, d][:, None] - entries[None, :, d]
            apart *= apart
            total = total[last[heads]] + apart
            last = np.cumsum(new) - 1
        found = total.argmin(1)
        best[start:end], error[start:end] = found, total[np.arange(len(found)), found]


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    waiting, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if n and n + part.num_rows > rows:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, n = [], 0
            waiting.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def train(kept: DataFrame, column: str, books: np.ndarray, dimensions: int) -> np.ndarray:
    """One round: assign every part, then move each entry to the floor of its parts' mean; unused ones stay.

    ``books`` is an array by part, entry and place.
    """
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for table in _grouped(batches, max(1, BLOCK // dimensions)):
            whole = integers(_column(table, column), dimensions, parts)
            for p in range(parts):
                trie = Trie(whole[:, p])
                best, _ = trie.nearest(books[p])
                np.add.at(n[p], best, trie.counts)
                np.add.at(sums[p], best, trie.rows * trie.counts[:, None])
        part, entry = np.nonzero(n)
        if len(part):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), rows],
                ["part", "entry", "n", "sums"],
            )

    told = kept.select(column).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    # A row for each entry at most: parts times entries.
    moved = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    books = books.copy()
    for row in moved.collect():
        books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return books


def codebooks(
    kept: DataFrame, id_column: str, column: str, dimensions: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray:
    """Codebooks learned from all rows: an integer array by part, entry and place. They start with the vectors of smallest id."""
    start = kept.select(id_column, column).orderBy(F.col(id_column).asc_nulls_last(), column).limit(entries).collect()
    rows = pa.array([[float(x) for x in r[column]] for r in start], pa.list_(pa.float64()))
    books = np.ascontiguousarray(integers(rows, dimensions, parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = train(kept, column, books, dimensions)
    return books


def encoded(kept: DataFrame, column: str, books: np.ndarray, dimensions: int) -> DataFrame:
    """The other columns of ``kept``, code (two hex digits for each part) and error (squared distances summed)."""
    parts = len(books)
    others = [c for c in kept.columns if c != column]
    out = kept.select(*others).schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, max(1, BLOCK // dimensions)):
            whole = integers(_column(table, column), dimensions, parts)
            codes, errors = np.empty((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p in range(parts):
                trie = Trie(whole[:, p])
                best, error = trie.nearest(books[p])
                codes[:, p], errors = best[trie.leaf], errors + error[trie.leaf]
            digits = codes.tobytes().hex()
            code = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string())
            yield from pa.table([*[table.column(c) for c in others], code, pa.array(errors)], names=out.names).to_batches()

    return kept.mapInArrow(run, out)


def digest(books: np.ndarray) -> str:
    """SHA-256 (hex) of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    column: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Codes of all usable vectors: the id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are those of another
    length than most (of equally frequent lengths the largest counts). A length that is no multiple of ``parts`` is filled
    up with zeros. Components are floor(256 * x), held within 2 ** 26 either way. Codebooks start with the
    ``entries`` smallest ids (nulls last, rows of one id in the order of their vectors; fewer, if there are fewer
    rows); at most 256 entries. label_error is the sum of error over the rows with an equal label, nulls together. Repeated rows are
    encoded each. A table without a usable row gives none.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    fine = usable(vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v"), F.col(label).alias("label")), "v")
    most = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    result = [F.col("id").alias(id_column), "code", "error", "label_error"]
    if most is None:
        none = fine.filter("false").select("id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")])
        return none.select(*result, F.lit("").alias("codebooks_sha256"))
    kept = fine.filter(F.size("v") == most["d"])
    books = codebooks(kept, "id", "v", most["d"], parts, entries, rounds)
    found = stored(encoded(kept, "v", books, most["d"]), "vector-codes")
    sums = stored(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    size: Row = sums.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_label").cast("string"))), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= LABELS and size["bytes"] <= LABEL_BYTES
    joined = found.join(F.broadcast(sums) if small else sums.hint("merge"), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(*result, F.lit(digest(books)).alias("codebooks_sha256"))
