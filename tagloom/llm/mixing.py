"""Temperature mixing of sources, realised as budgeted permutations of blocks.

A source's weight is its share of the tokens to the power of an exponent between 0 (all alike) and 1
(as they are), normalised. The exponent is found by bisection: the weights' entropy must reach a
target, or no source may repeat more often than a limit. Each source is then dealt as a permutation
of its blocks, once for every whole time its weight asks for it, and the last time until its budget
of tokens is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.shared import stored

#: Exponents tried in one pass over the sources, and passes.
STEPS, PASSES = 16, 8
#: Blocks of a source.
BLOCKS = 512


def tokens(text: str | Column) -> Column:
    """Number of words of a text, the measure of its length; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """Documents, tokens and share of the tokens of each source (``docs``: source, n_tokens)."""
    totals = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    whole = docs.agg(F.sum("n_tokens")).first()[0] or 1
    return totals.withColumn("share", F.col("n_tokens") / F.lit(whole))


def find_exponent(totals: DataFrame, entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` (a part of the greatest
    possible), or the smallest whose weights ask for no source more than ``max_repeat`` times.

    ``max_repeat`` needs ``budget``, the tokens of the mixture; without a budget it limits how much more
    often the rarest source is taken than the commonest. Both measures move one way with the exponent, so
    each pass over the sources tries a row of exponents and narrows the range to one step: a bisection
    with many arms. Only its sums reach the driver, never the sources.
    """
    if (entropy is None) == (max_repeat is None):
        raise ValueError("give either an entropy or a repetition limit")
    known = totals.filter("share > 0")
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * k / STEPS for k in range(STEPS + 1)]
        power = [F.pow("share", F.lit(a)) for a in tried]
        sums = [F.sum(p) for p in power]
        logs = [F.sum(p * F.log(p)) for p in power]
        steep = [F.max(p / F.col("share")) for p in power]
        flat = [F.min(p / F.col("share")) for p in power]
        size, total, *found = known.agg(F.count("*"), F.sum("n_tokens"), *sums, *logs, *steep, *flat).first()
        if not size or size == 1:
            return 1.0
        s, g, most, least = (found[k * (STEPS + 1) : (k + 1) * (STEPS + 1)] for k in range(4))
        if entropy is not None:
            # Entropy of p^a / S is log S - sum(p^a log p^a) / S; it falls as the exponent grows.
            fits = [math.log(x) - y / x >= entropy * math.log(size) - 1e-12 for x, y in zip(s, g, strict=True)]
            k = max((i for i, ok in enumerate(fits) if ok), default=0)
            low, high = tried[k], tried[min(k + 1, STEPS)]
        else:
            # A source is taken weight * budget / tokens times = p^(a-1) / S * budget / total times.
            times = [m / x * budget / total if budget else m / n for m, n, x in zip(most, least, s, strict=True)]
            k = min((i for i, t in enumerate(times) if t <= max_repeat + 1e-12), default=STEPS)
            low, high = tried[max(k - 1, 0)], tried[k]
    return low if entropy is not None else high


def weights(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """Add weight and target, the tokens to take of each source, to the totals.

    Without a budget it is the least that takes every document of every source at least once.
    """
    raw = totals.withColumn("weight", F.when(F.col("share") > 0, F.pow("share", F.lit(float(exponent)))).otherwise(0.0))
    whole, least = raw.agg(
        F.sum("weight"), F.max(F.when(F.col("share") > 0, F.col("n_tokens") / F.col("weight")))
    ).first()
    scale = (least or 0.0) if budget is None else budget / (whole or 1.0)
    return raw.withColumn("target", F.round(F.col("weight") * F.lit(float(scale))).cast("long")).withColumn(
        "weight", F.col("weight") / F.lit(whole or 1.0)
    )


def numbered(docs: DataFrame) -> DataFrame:
    """Add copy, a number from 1 among the rows of a doc_id, and n_tokens; equal rows are interchangeable."""
    order = Window.partitionBy("doc_id").orderBy("source", "_text")
    return (
        docs.select("doc_id", "source", tokens("text").alias("n_tokens"), F.xxhash64("text").alias("_text"))
        .withColumn("copy", F.row_number().over(order))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, with the columns of ``docs``: a document is repeated as often as
    :func:`mix` (which takes the options) takes it. Rows with a null doc_id are taken once."""
    own = docs.columns
    known = docs.filter("doc_id is not null")
    times = mix(known, **options).groupBy("doc_id").agg(F.collect_list("copy").alias("_copies"))
    order = Window.partitionBy("doc_id").orderBy("source", F.xxhash64("text"))
    dealt = known.withColumn("_copy", F.row_number().over(order)).hint("merge").join(times, "doc_id")
    again = dealt.withColumn("_again", F.explode(F.filter("_copies", lambda c: c == F.col("_copy"))))
    return again.select(*own).union(docs.filter("doc_id is null"))


def mix(
    docs: DataFrame,
    entropy: float | None = None,
    max_repeat: float | None = None,
    budget: float | None = None,
    seed: int = 0,
    n_blocks: int = BLOCKS,
) -> DataFrame:
    """Deal documents so that sources reach their weights.

    ``docs`` has doc_id, text and source; other columns are ignored. Returns a row for each time a
    document is taken: doc_id, copy (from 1 among rows of that id), source, n_tokens, epoch (from 0), block, weight, exponent, and start, the
    tokens of its source dealt before it. A document is taken in an epoch if its start lies before its
    source's target, so a source passes its target by less than one document. Documents of equal hash
    rank go by doc_id; a null source is a source of its own; null, empty and blank texts have no tokens and are
    always taken in the first epoch. Repeated rows are dealt as often as they occur.
    """
    sized = stored(numbered(docs).select("doc_id", "copy", "source", "n_tokens"), "sized")
    totals = stored(source_totals(sized), "totals")
    exponent = find_exponent(totals, entropy, max_repeat, budget)
    # A source of blank texts has no tokens; greatest passes over its null.
    goal = weights(totals, exponent, budget).withColumn(
        "epochs", F.greatest(F.lit(1), F.ceil(F.try_divide("target", "n_tokens"))).cast("int")
    )
    goal = stored(goal, "goal")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    drawn = lambda *of: F.xxhash64(F.lit(seed), *of)
    placed = sized.withColumn("block", F.pmod(drawn(F.lit("block"), "doc_id"), F.lit(n_blocks)).cast("int"))
    # Tokens by source and block: at most n_blocks rows a source.
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    turns = (
        sums.alias("b")
        .join(goal.alias("g"), same("b", "g"))
        .select(
            "b.source", "block", "n", F.col("g.n_tokens").alias("whole"), "target", "weight",
            F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"),
        )
        .withColumn("order", drawn(F.lit("turn"), "epoch", "block"))
    )
    run = Window.partitionBy("source", "epoch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.col("epoch") * F.col("whole") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    taken = turns.filter((F.col("before") < F.col("target")) | (F.col("epoch") == 0))
    dealt = (
        placed.alias("d")
        .join(taken.alias("t"), same("d", "t") & (F.col("d.block") == F.col("t.block")))
        .select("d.doc_id", "copy", "d.source", "n_tokens", "epoch", "d.block", "weight", "target", "before")
    )
    inside = (
        Window.partitionBy("source", "epoch", "block")
        .orderBy(drawn(F.lit("document"), "epoch", "doc_id"), "doc_id", "copy")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return (
        dealt.withColumn("start", start)
        .filter((F.col("start") < F.col("target")) | ((F.col("n_tokens") == 0) & (F.col("epoch") == 0)))
        .select("doc_id", "copy", "source", "n_tokens", "epoch", "block", "weight", F.lit(exponent).alias("exponent"), "start")
    )
