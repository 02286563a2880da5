"""Random forest: trees on drawn rows, each split chosen among a few drawn features by Gini impurity.

Nodes that hold many rows are split together: a pass over the rows adds up in the tasks how often each class falls into each bin of a
node's features, and only the best split of each node comes to the driver. All rows of a node that holds few go to one task, which grows
what is below it. These parts of trees stay a table, and rows to be predicted go to them, so the driver holds the splits of
large nodes only. Rows travel as one byte per feature, many in one packed row.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import SPLIT_SEED
from tagloom.functions import arrays as fn
from tagloom.session import stored

#: Bins of a feature, and quantiles that tell whether it has few values.
BINS, QUANTILES = 32, 1_024
#: Drawn rows of a node that one task takes, rows that a part of a tree predicts in one step, and rows that are packed into one.
PART_ROWS, PIECE_ROWS, PACKED_ROWS = 1 << 16, 1 << 16, 1 << 12
#: Numbers of the counts that a task holds at once: while it grows a part, and in a pass over all rows.
PART_NUMBERS, PASS_NUMBERS = 1 << 20, 1 << 23
#: Where a node ends in a tree: at a leaf, or in a part of its own.
LEAF, PART = -1, -2

_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
_GROWN = "tree int, node long, feature array<int>, cut array<int>, left array<int>, at array<int>, class array<int>, share array<double>"


class Tree(NamedTuple):
    """Nodes of a tree or a part of one: feature (or LEAF, PART), last bin that goes left, left child (the right one is next), number."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    number: np.ndarray


def _random(*parts) -> np.ndarray:
    """Numbers from 0 to 1 that follow from whole numbers."""
    out = np.zeros(1, np.uint64)
    for part in parts:
        out = out + np.asarray(part).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = out ^ (out >> np.uint64(31))
    return (out >> np.uint64(11)) * 2.0**-53


def _drawn(seed: int | None, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is in a tree's sample with replacement; without a seed, once."""
    if seed is None:
        return np.ones(len(rows), np.int64)
    return np.searchsorted(_POISSON, _random(seed, 1, tree, rows), side="right")


def _chosen(seed: int, tree, numbers: np.ndarray, features: int, k: int) -> np.ndarray:
    """``k`` features for each node."""
    if k >= features:
        return np.broadcast_to(np.arange(features), (len(numbers), features))
    drawn = _random(seed, 2, np.asarray(tree)[..., None], numbers[:, None], np.arange(features))
    return np.sort(np.argpartition(drawn, k, axis=1)[:, :k], axis=1)


def _counted(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, slot: np.ndarray, chosen: np.ndarray, classes: int) -> np.ndarray:
    """Rows by node, feature, bin and class."""
    nodes, k = chosen.shape
    place = (slot[:, None] * k + np.arange(k)) * BINS + np.take_along_axis(bins, chosen[slot], axis=1)
    place = place * classes + label[:, None]
    return np.bincount(place.ravel(), np.repeat(weight, k), nodes * k * BINS * classes).reshape(nodes, k, BINS, classes)


def _best(counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature (or LEAF, if none makes a node purer) and last bin on the left of each node's best split."""
    square = lambda a: np.einsum("...c,...c->...", a, a)
    whole = counts[:, 0].sum(1)
    left = counts.cumsum(2)[:, :, :-1]
    right = whole[:, None, None] - left
    n, m = left.sum(-1), right.sum(-1)
    score = np.where((n > 0) & (m > 0), square(left) / np.maximum(n, 1) + square(right) / np.maximum(m, 1), 0.0)
    score = score.reshape(len(counts), -1)
    at = score.argmax(1)
    rows = np.arange(len(counts))
    purer = score[rows, at] > (square(whole) / np.maximum(whole.sum(1), 1)) * (1 + 1e-12)
    return np.where(purer, chosen[rows, at // (BINS - 1)], LEAF), np.where(purer, at % (BINS - 1), 0)


def _walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    node = np.zeros(len(bins), np.int64)
    going = np.arange(len(bins))
    while len(going := going[tree.feature[node[going]] >= 0]):
        own = node[going]
        node[going] = tree.left[own] + (bins[going, tree.feature[own]] > tree.cut[own])
    return node


def _grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, k: int, seed: int, tree: int, number: int, depth: int):
    """All below a node, level by level: feature, cut and left of each node, and where, what and how much its leaves vote."""
    feature, cut, left, votes = [], [], [], []
    numbers, slot, first = np.array([number]), np.zeros(len(bins), np.int64), 0
    step = max(1, PART_NUMBERS // (k * BINS * classes))
    while len(numbers):
        n = len(numbers)
        sums = np.bincount(slot * classes + label, weight, n * classes).reshape(n, classes)
        f, c = np.full(n, LEAF), np.zeros(n, np.int64)
        mixed = np.flatnonzero((sums > 0).sum(1) > 1) if depth > 0 else np.array([], np.int64)
        for some in (mixed[i : i + step] for i in range(0, len(mixed), step)):
            place = np.full(n, -1)
            place[some] = np.arange(len(some))
            own = place[slot]
            use = np.flatnonzero(own >= 0)
            chosen = _chosen(seed, tree, numbers[some], bins.shape[1], k)
            f[some], c[some] = _best(_counted(bins[use], label[use], weight[use], own[use], chosen, classes), chosen)
        parted = f >= 0
        at, found = np.nonzero(np.where(parted[:, None], 0.0, sums))
        votes.append((at + first, found, sums[at, found] / sums[at].sum(1)))
        child = first + n + 2 * (np.cumsum(parted) - 1)
        feature.append(f)
        cut.append(c)
        left.append(np.where(parted, child, 0))
        stay = np.flatnonzero(parted[slot])
        bins, label, weight, slot = bins[stay], label[stay], weight[stay], slot[stay]
        right = bins[np.arange(len(bins)), f[slot]] > c[slot]
        slot = child[slot] - (first + n) + right
        numbers = (2 * numbers[parted][:, None] + np.array([0, 1])).ravel()
        first, depth = first + n, depth - 1
    return [np.concatenate(x) for x in (feature, cut, left, *zip(*votes, strict=True))]


def _bytes(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _packed(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _one(schema: str, tree: int, keys: np.ndarray, rows: list[np.ndarray], *columns: np.ndarray, chunk: int | None = None) -> pa.RecordBatch:
    """Rows of a tree, packed by node."""
    data = [pa.array(np.full(len(keys), tree, np.int32)), pa.array(keys)]
    if chunk is not None:
        data.append(pa.array(np.full(len(keys), chunk, np.int64)))
    data += [pa.array([c[r].tobytes() for r in rows], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(data, [c.split()[0] for c in schema.split(", ")])


def _by_node(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different numbers, and the rows of each."""
    order = np.argsort(numbers, kind="stable")
    keys, starts = np.unique(numbers[order], return_index=True)
    return keys, np.split(rows[order], starts[1:]) if len(keys) else []


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, PACKED_ROWS):
            yield whole.slice(at, PACKED_ROWS)


def _binned(cuts: list[np.ndarray], names: list[str]):
    """Vectors as bytes, the number of the bin of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1)
            bins = np.empty(x.shape, np.uint8)
            for j, borders in enumerate(cuts):
                bins[:, j] = np.searchsorted(borders, x[:, j])
            data = [batch.column(c) for c in names[:-1]] + [pa.array([r.tobytes() for r in bins], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names)

    return run


class RandomForest:
    """Fits like the other classifiers. A split looks at the root of the number of features, at all if there is one tree."""

    #: Whether a tree learns from drawn rows; else from every row once.
    draws = True

    def __init__(self, trees: int = 100, max_depth: int = 30, seed: int = SPLIT_SEED):
        self.trees, self.max_depth, self.seed = trees, max_depth, seed
        self.features_column, self.label_column, self.prediction_column = "features", "label", "prediction"

    def copy(self):
        return copy.copy(self)

    def setFeaturesCol(self, name: str):  # noqa: N802  (as Spark's own classifiers)
        self.features_column = name
        return self

    def setLabelCol(self, name: str):  # noqa: N802
        self.label_column = name
        return self

    def setPredictionCol(self, name: str):  # noqa: N802
        self.prediction_column = name
        return self

    def fit(self, train: DataFrame) -> ForestModel:
        x, y = _array(train, self.features_column), F.col(self.label_column)
        wrong = y.isNull() | x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
        refuse = F.raise_error(F.lit("labels must not be null, vectors neither null nor hold null, NaN or infinity"))
        ready = train.select(y.cast("int").alias("label"), F.when(wrong, refuse).otherwise(x).alias("x"))
        seen = ready.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("last"), F.max(F.size("x")).alias("size")).first()
        if not seen["n"]:
            raise ValueError("no row to learn from")
        cuts = _borders(ready, seen["size"])
        # numbered and stored once: whether a row is drawn follows from its number
        names = ["row", "label", "bins"]
        binned = ready.select(F.monotonically_increasing_id().alias("row"), "label", "x").mapInArrow(
            _binned(cuts, names), "row long, label int, bins binary"
        )
        rows = stored(binned, "forest_rows")
        k = seen["size"] if self.trees == 1 else math.ceil(math.sqrt(seen["size"]))
        grower = _Grower(rows, seen["size"], seen["last"] + 1, k, self.trees, self.max_depth, self.seed, self.draws)
        tops, leaves = grower.tops(seen["n"])
        parts = grower.parts(tops).union(train.sparkSession.createDataFrame(leaves, _GROWN))
        return ForestModel(cuts, tops, stored(parts, "forest_parts"), seen["last"] + 1, self.features_column, self.prediction_column)


class DecisionTree(RandomForest):
    """One tree from every row and all features, grown like those of a forest."""

    draws = False

    def __init__(self, max_depth: int = 30, seed: int = SPLIT_SEED):
        super().__init__(1, max_depth, seed)


class _Grower:
    def __init__(self, rows: DataFrame, size: int, classes: int, k: int, trees: int, max_depth: int, seed: int, draws: bool = True):
        self.rows, self.size, self.classes, self.k, self.trees, self.max_depth, self.seed = rows, size, classes, k, trees, max_depth, seed
        self.draw = seed if draws else None

    def tops(self, n: int) -> tuple[list[Tree], list[tuple]]:
        """The splits of large nodes, and the leaves among these nodes (rows of the table of parts)."""
        nodes: list[dict[int, tuple[int, int]]] = [{1: (PART, 0)} for _ in range(self.trees)]
        leaves, large = [], [(t, 1) for t in range(self.trees)] if n > PART_ROWS else []
        step = max(1, PASS_NUMBERS // (self.k * BINS * self.classes))
        while large:
            tops, after = [_tree(x) for x in nodes], []
            for some in (large[i : i + step] for i in range(0, len(large), step)):
                for r in self._splits(tops, some).collect():
                    tree, number, last = r["tree"], r["node"], r["node"].bit_length() > self.max_depth
                    if last or r["feature"] == LEAF:
                        found = [i for i, v in enumerate(r["sums"]) if v]
                        share = [r["sums"][i] / sum(r["sums"]) for i in found]
                        leaves.append((tree, number, [LEAF], [0], [0], [0] * len(found), found, share))
                        # no rows are sent there to grow
                        nodes[tree][number] = (LEAF, 0)
                        continue
                    nodes[tree][number] = (r["feature"], r["cut"])
                    for child, rows in ((2 * number, r["n_left"]), (2 * number + 1, sum(r["sums"]) - r["n_left"])):
                        nodes[tree][child] = (PART, 0)
                        if rows > PART_ROWS:
                            after.append((tree, child))
            large = after
        return [_tree(x) for x in nodes], leaves

    def _splits(self, tops: list[Tree], large: list[tuple[int, int]]) -> DataFrame:
        """The best split of each of these nodes, a row each."""
        size, classes, k, seed, draw = self.size, self.classes, self.k, self.seed, self.draw
        wanted: dict[int, np.ndarray] = {}
        for tree, number in large:
            wanted[tree] = np.append(wanted.get(tree, np.array([], np.int64)), number)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in _steps(batches):
                bins, row, label = _bytes(batch.column("bins"), size), np.asarray(batch.column("row")), np.asarray(batch.column("label"))
                for tree, numbers in wanted.items():
                    weight = _drawn(draw, tree, row)
                    numbers = np.sort(numbers)
                    at = tops[tree].number[_walk(tops[tree], bins)]
                    slot = np.minimum(np.searchsorted(numbers, at), len(numbers) - 1)
                    use = np.flatnonzero((numbers[slot] == at) & (weight > 0))
                    found = _counted(bins[use], label[use], weight[use], slot[use], _chosen(seed, tree, numbers, size, k), classes)
                    sums[tree] = sums[tree] + found if tree in sums else found
            for tree, found in sums.items():
                numbers = np.sort(wanted[tree])
                stats = pa.array(list(found.reshape(len(numbers), -1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), tree, np.int32)), pa.array(numbers), stats], ["tree", "node", "stats"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                    tree, number = np.asarray(batch.column("tree")), np.asarray(batch.column("node"))
                    stats = np.asarray(batch.column("stats").flatten(), np.float64).reshape(len(tree), -1, BINS, classes)
                    chosen = _chosen(seed, tree, number, size, k)
                    feature, cut = _best(stats, chosen)
                    own = (chosen == feature[:, None]).argmax(1)
                    n_left = np.array([stats[i, own[i], : cut[i] + 1].sum() for i in range(len(tree))])
                    data = [tree, number, feature.astype(np.int32), cut.astype(np.int32), n_left, list(stats[:, 0].sum(1))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], ["tree", "node", "feature", "cut", "n_left", "sums"])

        counted = self.rows.mapInArrow(count, "tree int, node long, stats array<double>")
        summed = counted.groupBy("tree", "node").agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))
        return summed.mapInArrow(choose, "tree int, node long, feature int, cut int, n_left double, sums array<double>")

    def parts(self, tops: list[Tree]) -> DataFrame:
        """What is below the nodes that hold few rows, a row per node."""
        size, classes, k, seed, max_depth, draw = self.size, self.classes, self.k, self.seed, self.max_depth, self.draw
        schema = "tree int, node long, bins binary, label binary, weight binary"

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _steps(batches):
                bins, row = _bytes(batch.column("bins"), size), np.asarray(batch.column("row"))
                label = np.asarray(batch.column("label"), np.int32)
                for number, tree in enumerate(tops):
                    weight = _drawn(draw, number, row).astype(np.uint8)
                    own = np.flatnonzero(weight)
                    at = _walk(tree, bins[own])
                    keep = tree.feature[at] == PART
                    keys, rows = _by_node(tree.number[at[keep]], own[keep])
                    yield _one(schema, number, keys, rows, bins, label, weight)

        def grow(rows: pa.Table) -> pa.Table:
            tree, node = rows["tree"][0].as_py(), rows["node"][0].as_py()
            bins, label = _bytes(rows["bins"], size), _packed(rows["label"], np.int32)
            found = _grow(
                bins, label.astype(np.int64), _packed(rows["weight"], np.uint8), classes, k, seed, tree, node, max_depth + 1 - node.bit_length()
            )
            data = [pa.array([tree], pa.int32()), pa.array([node])]
            data += [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in found[:-1]] + [pa.array([found[-1]], pa.list_(pa.float64()))]
            return pa.table(data, [c.split()[0] for c in _GROWN.split(", ")])

        return self.rows.mapInArrow(deal, schema).groupBy("tree", "node").applyInArrow(grow, _GROWN)


class ForestModel:
    def __init__(self, cuts: list[np.ndarray], tops: list[Tree], parts: DataFrame, classes: int, features: str, prediction: str):
        self.cuts, self.tops, self.parts, self.classes, self.features, self.prediction = cuts, tops, parts, classes, features, prediction

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the class number for which the trees vote most, each by the shares of its leaf; null for a null vector."""
        asked = stored(df.withColumn("__row", F.monotonically_increasing_id()), "asked")
        x = _array(asked, self.features)
        binned = asked.filter(x.isNotNull()).select(F.col("__row").alias("row"), x.alias("x")).mapInArrow(
            _binned(self.cuts, ["row", "bins"]), "row long, bins binary"
        )
        found = self._voted(stored(binned, "asked_bins")).withColumnsRenamed({"row": "__row", "best": "__best"})
        both = asked.join(found, "__row", "left")
        return both.select(*[asked[c] for c in df.columns], F.col("__best").cast("double").alias(self.prediction))

    def _voted(self, rows: DataFrame) -> DataFrame:
        """(row, best)."""
        tops, size, classes = self.tops, len(self.cuts), self.classes
        schema = "tree int, node long, chunk long, row binary, bins binary"

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _steps(batches):
                bins, row = _bytes(batch.column("bins"), size), np.asarray(batch.column("row"), np.int64)
                for number, tree in enumerate(tops):
                    keys, own = _by_node(tree.number[_walk(tree, bins)], np.arange(len(row)))
                    yield _one(schema, number, keys, own, row, bins, chunk=row[0])

        def vote(parts: pa.Table, asked: pa.Table) -> pa.Table:
            if not parts.num_rows or not asked.num_rows:
                return pa.table([pa.array([], pa.int64())] + [pa.array([], pa.binary())] * 3, ["chunk", "row", "class", "share"])
            part = {c: np.asarray(parts[c].combine_chunks().flatten()) for c in ("feature", "cut", "left", "at", "class", "share")}
            tree = Tree(part["feature"], part["cut"], part["left"], part["left"])
            out = []
            for row, bins in zip(asked["row"].to_pylist(), asked["bins"].to_pylist(), strict=True):
                node = _walk(tree, np.frombuffer(bins, np.uint8).reshape(-1, size))
                first, last = (np.searchsorted(part["at"], node, side) for side in ("left", "right"))
                n = last - first
                which = np.repeat(first - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())
                rows = np.repeat(np.frombuffer(row, np.int64), n)
                out.append((rows.tobytes(), part["class"][which].astype(np.int32).tobytes(), part["share"][which].tobytes()))
            return pa.table([asked["chunk"], *[pa.array(c, pa.binary()) for c in zip(*out, strict=True)]], ["chunk", "row", "class", "share"])

        def add(votes: pa.Table) -> pa.Table:
            rows, at = np.unique(_packed(votes["row"], np.int64), return_inverse=True)
            place = at * classes + _packed(votes["class"], np.int32)
            # the least class of equally strong ones, whatever the order of the trees
            sums = np.bincount(place, _packed(votes["share"], np.float64), len(rows) * classes).reshape(-1, classes).round(9)
            return pa.table([pa.array(rows), pa.array(sums.argmax(1).astype(np.int32))], ["row", "best"])

        dealt = rows.mapInArrow(deal, schema)
        counts = dealt.groupBy("tree", "node").agg(F.sum(F.length("row") / 8).alias("n"))
        pieces = counts.select("tree", "node", F.ceil(F.col("n") / F.lit(PIECE_ROWS)).cast("int").alias("pieces"))
        # one row per part
        pieces = F.broadcast(stored(pieces, "forest_pieces"))
        parts = self.parts.join(pieces, ["tree", "node"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        asked = dealt.join(pieces, ["tree", "node"]).withColumn("piece", F.pmod(F.xxhash64("chunk"), F.col("pieces")).cast("int"))
        keys = ("tree", "node", "piece")
        voted = (
            parts.drop("pieces").groupBy(*keys)
            .cogroup(asked.drop("pieces").groupBy(*keys))
            .applyInArrow(vote, "chunk long, row binary, class binary, share binary")
        )
        return voted.groupBy("chunk").applyInArrow(add, "row long, best int")


def _tree(nodes: dict[int, tuple[int, int]]) -> Tree:
    """Nodes by number as arrays, level by level, so that children of a node are neighbours."""
    numbers = sorted(nodes)
    place = {number: i for i, number in enumerate(numbers)}
    left = [place.get(2 * number, 0) for number in numbers]
    return Tree(*[np.array(x, np.int64) for x in ([nodes[i][0] for i in numbers], [nodes[i][1] for i in numbers], left, numbers)])


def _borders(rows: DataFrame, size: int) -> list[np.ndarray]:
    """Borders of the bins of each feature: all its values if these are few, else quantiles."""
    share = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    entries = rows.select(F.posexplode("x").alias("pos", "value"))
    found = entries.groupBy("pos").agg(F.percentile_approx("value", share, 10_000).alias("q")).collect()  # a row per feature
    out = [np.array([])] * size
    for r in found:
        values = np.unique(r["q"])
        out[r["pos"]] = values if len(values) < BINS else np.unique(r["q"][QUANTILES // BINS - 1 :: QUANTILES // BINS])
    return out


def _array(df: DataFrame, name: str) -> Column:
    return vector_to_array(F.col(name)) if isinstance(df.schema[name].dataType, VectorUDT) else fn.doubles(name)
