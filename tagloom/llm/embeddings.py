"""Near-duplicate embeddings by a pivot-permutation index.

Reference vectors (pivots) are drawn from the table. A vector is described by its nearest pivots in order.
The inverted lists hold, for each two pivots, the vectors that have both among their nearest; vectors that
share a list share two pivots at least, and are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.groups import components
from tagloom.llm.jaccard import grouped, local_components
from tagloom.llm.shared import stored

#: Pivots, drawn by a hash of the vector from at most about twice as many rows, and how many describe a vector.
PIVOTS, NEAREST = 128, 6
#: Most vectors in a block of a list.
BLOCK = 1024


def is_usable(dimensions: int) -> Column:
    """Whether a row (id, v) can be linked: finite components, not all zero, of the right number, and an id."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dimensions)
    return F.coalesce(whole & fine & F.exists("v", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, id_column: str, column: str, dimensions: int) -> DataFrame:
    """Rows (id, v) with finite components, not all zero, of the right number; v is an array of doubles."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    return rows.filter(is_usable(dimensions))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of length 1; scaled first so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def draw_pivots(found: DataFrame, dimensions: int, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` different rows of ``found`` (id, v), of a hash-drawn sample of bounded size."""
    n = found.count()
    share = min(1.0, 2.0 * pivots / max(1, n))
    drawn = found.filter(F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.lit(10**9)) < share * 10**9)
    rows = drawn.select("v").dropDuplicates().orderBy(F.xxhash64("v")).limit(pivots).toPandas()
    if not len(rows):
        return np.zeros((0, dimensions))
    return _matrix(pa.array(rows["v"].tolist(), pa.list_(pa.float64())), dimensions)


def described(classes: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """A row for each inverted list that a vector is in: one, other (pivots, one < other), then id, copies, v and
    near, the bits of its nearest pivots."""
    dimensions = pivots.shape[1]
    k = min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                x = _matrix(block.column("v"), dimensions)
                order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]
                near = np.zeros((len(x), len(pivots)), bool)
                np.put_along_axis(near, order, True, 1)
                bits = [row.tobytes() for row in np.packbits(near, axis=1)]
                own = np.sort(order, 1)
                # With one pivot only, it is the one list.
                pairs = [(i, j) for i in range(k) for j in range(i + 1, k)] or [(0, 0)]
                rows = np.repeat(np.arange(len(x)), len(pairs))
                one, other = (own[:, [p[s] for p in pairs]].ravel().astype(np.int64) for s in (0, 1))
                take = block.select(["id", "copies", "v"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(other), *take.columns, pa.array(bits, pa.binary()).take(pa.array(rows))],
                    ["one", "other", "id", "copies", "v", "near"],
                )

    return classes.mapInArrow(run, "one long, other long, id long, copies long, v array<double>, near binary")


def _verify(dimensions: int, pivots: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 4):
            one, other, low, high = (group.column(c)[0].as_py() for c in ("one", "other", "low", "high"))
            ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
            block = group.column("block").to_numpy()
            x = _matrix(group.column("v").combine_chunks(), dimensions)
            bits = np.frombuffer(b"".join(group.column("near").to_pylist()), np.uint8).reshape(len(ids), -1)
            near = np.unpackbits(bits, axis=1)[:, :pivots].astype(np.float32)
            # A pair counts in the list of the two smallest pivots that it shares.
            near[:, other:] = 0
            near[:, one] = 0
            hits = x @ x.T >= least
            np.fill_diagonal(hits, False)
            if low != high:
                hits &= block[:, None] != block[None, :]
            first = hits & (near @ near.T == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ids[local_components(hits)]), pa.array((first @ copies).astype(np.int64))],
                ["id", "to", "links"],
            )

    return run


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    column: str = "embedding",
    least: float = 0.9,
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
) -> DataFrame:
    """Groups of vectors with cosine ``least`` or more: id, n_links, component_id and kept for each row.

    All rows are indexed; only the pivots come from a sample. A pair is found if two of the ``nearest`` pivots
    of both are the same, and its cosine decides. n_links counts the other vectors linked directly,
    component_id is the smallest id reachable, kept says that it is the row's own. Vectors that are null, zero, of
    another length than most or hold null or non-finite components link with nothing, nor do rows with a
    null id. Equal vectors are indexed once and count as often as they occur. An empty table gives no rows.
    """
    sizes = vectors.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    dimensions = most["d"] if most else 0
    found = stored(usable(vectors, id_column, column, dimensions), "vectors")
    keyed = F.xxhash64("v").alias("twin"), F.col("v")
    classes = stored(
        found.groupBy(*keyed).agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "v"), "vector-classes"
    )
    points = draw_pivots(found, dimensions, pivots)
    out = F.col(id_column).alias("id")
    if not len(points):
        return vectors.select(
            F.col(id_column), F.lit(0).cast("long").alias("n_links"), out.alias("component_id"), F.lit(True).alias("kept")
        )
    lists = stored(described(classes, points, nearest), "vector-lists")
    cut = lists.groupBy("one", "other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cut"))
    # At most one row for each two pivots.
    placed = lists.join(F.broadcast(cut), ["one", "other"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).select(
        "one", "other", F.least("block", "with").cast("long").alias("low"), F.greatest("block", "with").cast("long").alias("high"),
        "id", "copies", "v", "near", "block",
    )
    keys = ("one", "other", "low", "high")
    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    linked = stored(dealt.mapInArrow(_verify(dimensions, len(points), least), "id long, to long, links long"), "vector-links")
    groups = components(linked.select("id", "to"), "vector-groups")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    own = (
        classes.join(links, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    rows = vectors.select(out, F.col(column).cast("array<double>").alias("v"))
    each = found.withColumn("twin", F.xxhash64("v")).join(own.withColumn("twin", F.xxhash64("v")), ["twin", "v"]).select("id", "n_links", "component_id")
    rest = rows.filter(~is_usable(dimensions)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return each.union(rest).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
