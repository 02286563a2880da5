"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are hashes of a text's words and of the words' first letters, so that a word counts whatever its
ending. The model gives P(grade <= k) = sigmoid(threshold_k - weights . features): one weight for each
feature, shared by all thresholds, and thresholds in ascending order. The grade of a labelled text is 0 if
it is not toxic and else rises with the number of its features that the labels show to be telling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.shared import blocks, mix, text_bytes, words

#: Most labelled texts of either label that the model is fitted on; a hash of the id picks them.
MOST_TEXTS = 5_000
#: Most features, and least number of different labelled texts that must have one.
MOST_FEATURES, LEAST_TEXTS = 4096, 3
#: First letters (bytes of UTF-8, A-Z folded) that are features besides the whole word.
PREFIXES = (4, 5, 6)
#: Least likelihood ratio (twice its logarithm) of a feature: below it, chance explains it.
LEAST_RATIO = 11.0
#: Shares of the toxic texts up to which grades 1 and 2 go; the rest has grade 3.
GRADE_SHARES = (1 / 3, 2 / 3)
PENALTY = 1e-4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words of a block of texts (a row for each kind), and the words before each text."""
    raw, _ = text_bytes(texts)
    codes, starts, ends, first = words(texts, fold=True)
    # The word without the marks of punctuation around it, as far as they are ASCII.
    mark = np.zeros(256, bool)
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        more = (ends - starts > 1)
        starts += more & mark[raw[np.minimum(starts, len(raw) - 1)]] if len(raw) else 0
        more = (ends - starts > 1)
        ends -= more & mark[raw[np.maximum(ends - 1, 0)]] if len(raw) else 0
    letter = raw.copy()
    letter[(raw >= 65) & (raw <= 90)] += 32
    padded = np.concatenate([letter, np.zeros(64, np.uint8)]).astype(np.uint64)
    kinds = []
    for size in (*PREFIXES, 48):
        code = np.full(len(starts), size, np.uint64)
        length = ends - starts
        live = np.arange(len(starts))
        for k in range(size):
            live = live[length[live] > k]
            if not len(live):
                break
            code[live] = (code[live] + padded[starts[live] + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            code[live] ^= code[live] >> np.uint64(29)
        kinds.append(mix(code))
    return np.stack(kinds), first


@dataclass
class Grader:
    """A fitted model: feature hashes in ascending order, their weights, and the thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score, a column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))
        ends = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1)
        return np.diff(ends, axis=1)


def _known(kinds: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text and known feature."""
    n = len(first) - 1
    if not len(hashes) or not kinds.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    pairs = []
    for row in kinds:
        at = np.minimum(np.searchsorted(hashes, row), len(hashes) - 1)
        hit = hashes[at] == row
        pairs.append(owner[hit] * len(hashes) + at[hit])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(hashes), pairs % len(hashes)


def fit_ordinal(owner: np.ndarray, feature: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a proportional-odds model by penalised maximum likelihood (Adam).

    ``owner`` and ``feature`` are the pairs of row and present feature. Thresholds are the first one and
    positive gaps, so they stay in order.
    """
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    share = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(n_features), start[:1], gaps])
    # Both labels weigh alike.
    rate = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    m, v = np.zeros_like(x), np.zeros_like(x)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        w, limits = x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])
        score = np.bincount(owner, weights=w[feature], minlength=n)
        high = np.where(grades < top, sig(limits[np.minimum(grades, top - 1)] - score), 1.0)
        low = np.where(grades > 0, sig(limits[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p * rate, low * (1 - low) / p * rate
        by_score = d_high - d_low
        g_limits = np.bincount(np.maximum(grades - 1, 0), weights=d_low, minlength=top)[:top]
        g_limits -= np.bincount(np.minimum(grades, top - 1), weights=d_high, minlength=top)[:top]
        g = np.concatenate([np.bincount(feature, weights=by_score[owner], minlength=n_features) + penalty * w, [g_limits.sum()], np.cumsum(g_limits[::-1])[::-1][1:] * np.exp(x[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS) -> Grader:
    """Fit grades on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1).

    Rows without text or label teach nothing; of equal texts one teaches, and of several labels of a
    document the largest. Takes at most about ``most`` texts of either label, by a hash of the id. Without
    texts of both labels the model grades everything 0.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Grader(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0, 40.0, 50.0]))
    if not (sizes.get(0) and sum(n for k, n in sizes.items() if k > 0)):
        return none
    toxic = sum(n for k, n in sizes.items() if k > 0)
    keep = F.when(F.col("toxic") > 0, F.lit(most / toxic)).otherwise(F.lit(most / sizes[0]))
    # At most about twice ``most`` rows.
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < keep * 1_000_000)
    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.dropDuplicates(["text"]).withColumn("toxic", (F.col("toxic") > 0).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            kinds, first = features(block.column("text"))
            each = [np.unique(kinds[:, a:b]).view(np.int64) for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("toxic"), pa.array(each, pa.list_(pa.int64()))], ["doc_id", "toxic", "found"]
            )

    sparse = sample.mapInArrow(run, "doc_id long, toxic int, found array<long>").persist()
    try:
        labels_seen = {r["toxic"]: r["n"] for r in sparse.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(labels_seen) < 2:
            return none
        each = sparse.select("toxic", F.explode("found").alias("feature"))
        counts = each.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
        all_bad, all_good = labels_seen[1], labels_seen[0]
        bad, good = F.col("bad"), F.col("n") - F.col("bad")
        lift = F.log(((bad + 0.5) / (all_bad + 1)) / ((good + 0.5) / (all_good + 1)))

        def part(seen, all_seen: int):
            """What one label adds to the likelihood ratio: texts with and without the feature."""
            share = all_seen / (all_bad + all_good)
            rest, others = F.lit(all_seen) - seen, F.lit(all_bad + all_good) - F.col("n")
            x_log_x = lambda x, of: F.when(x > 0, x * F.log(x / (of * share))).otherwise(0.0)
            return x_log_x(seen, F.col("n")) + x_log_x(rest, others)

        ranked = counts.withColumn("lift", lift).withColumn("rank", 2 * (part(bad, all_bad) + part(good, all_good)))
        ranked = ranked.filter(F.col("rank") >= LEAST_RATIO)
        top = ranked.orderBy(F.desc("rank"), "feature").limit(MOST_FEATURES).select("feature", "lift", "n", "bad").toPandas()
        if not len(top):
            return none
        top = top.sort_values("feature", key=lambda s: s.to_numpy().view(np.uint64))
        hashes = top["feature"].to_numpy(np.int64).view(np.uint64)
        # What the driver gets is a bounded number of texts, with chosen features only.
        wanted = each.sparkSession.createDataFrame(top[["feature"]])
        rows = (
            sparse.select("doc_id", "toxic", F.explode("found").alias("feature"))
            .join(F.broadcast(wanted), "feature")
            .groupBy("doc_id", "toxic")
            .agg(F.collect_list("feature").alias("found"))
        )
        rows = sparse.select("doc_id", "toxic").join(rows, ["doc_id", "toxic"], "left").toPandas()
    finally:
        sparse.unpersist()
    rows = rows.sort_values("doc_id")
    lists = [np.asarray(x if x is not None else [], np.int64).view(np.uint64) for x in rows["found"]]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.searchsorted(hashes, np.concatenate(lists) if lists else np.zeros(0, np.uint64))
    telling = ((top["lift"] > 2.0) & (top["bad"] >= 0.9 * top["n"]) & (top["n"] >= 3 * LEAST_TEXTS)).to_numpy()
    number = np.bincount(owner, weights=telling[feature].astype(float), minlength=len(lists))
    toxic = rows["toxic"].to_numpy()
    starts = np.unique(np.quantile(number[toxic > 0], GRADE_SHARES))
    grades = np.where(toxic > 0, 1 + np.searchsorted(starts, number, "left"), 0)
    grades = np.unique(grades, return_inverse=True)[1]
    weights, thresholds = fit_ordinal(owner, feature, grades, len(hashes))
    return Grader(hashes, weights, thresholds)


def grade(docs: DataFrame, model: Grader) -> DataFrame:
    """Severity of each text of ``docs``: its columns and severity (expected grade), grade (the likeliest),
    p_toxic (probability of a grade above 0).

    Features count once a text, so a long text is not worse for its length. Null, empty and blank
    texts have severity 0. Rows are kept as they are; columns of those names are replaced.
    """
    own = docs.select(*[c for c in docs.columns if c not in ("severity", "grade", "p_toxic")])
    kinds_out = T.StructType(
        [*own.schema.fields, *T.StructType.fromDDL("severity double, grade int, p_toxic double").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            kinds, first = features(block.column("text"))
            owner, feature = _known(kinds, first, model.hashes)
            score = np.bincount(owner, weights=model.weights[feature], minlength=block.num_rows)
            p = model.probabilities(score)
            p[np.diff(first) == 0] = [1.0] + [0.0] * (p.shape[1] - 1)
            graded = p @ np.arange(p.shape[1]), p.argmax(1).astype(np.int32), 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays([*block.columns, *map(pa.array, graded)], kinds_out.names)

    return own.mapInArrow(run, kinds_out)
