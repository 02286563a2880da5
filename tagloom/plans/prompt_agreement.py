"""Labels and attributes -> prompts -> answers -> agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.constants import NULL_MARKERS, SAMPLE_SEED
from tagloom.functions.text import prompt_payload
from tagloom.operators import attributes as at
from tagloom.operators import classify as cf
from tagloom.operators import evaluate as ev
from tagloom.operators import labels as lb
from tagloom.operators import text as tx


def prompts(
    labels: DataFrame,
    attributes: DataFrame,
    n: int,
    fields: Sequence[str],
    seed: int = SAMPLE_SEED,
    markers: Iterable[str] = NULL_MARKERS,
    position: str | None = None,
) -> DataFrame:
    """Prompts for ``n`` labelled records: (sample_id, prompt). Of repeated ids the last by ``position`` counts; without
    that column there must be none."""
    usable = lb.labelled_only(_last(labels, position))
    chosen = lb.uniform_sample(usable, n, "sample_id", seed)
    found = lb.restrict_to_ids(attributes, chosen, keep=True)
    cleaned = at.null_markers(found, fields, markers)
    return tx.build_prompts(cleaned, fields, lb.class_values(usable, "source_type"))


def answer_pending(
    prompt_table: DataFrame,
    answers: DataFrame | None,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    force: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Answers for the prompts that have none yet. ``scorer`` gets sample_id and prompt."""
    pending = prompt_table if answers is None else lb.pending_prompts(
        prompt_table, answers, force=force
    )
    payload = pending.withColumn("prompt", prompt_payload("prompt"))
    return cf.score_batches(payload, scorer, ["sample_id", "prompt"], partitions=partitions)


def _last(labels: DataFrame, position: str | None) -> DataFrame:
    return lb.last_wins(labels, "sample_id", position) if position else labels


def agreement(answers: DataFrame, labels: DataFrame, position: str | None = None) -> DataFrame:
    """One row per answer: the category it names, the curated one, whether both are the same. The curated one is the
    last by ``position``, or the largest of those with the same id if there is no such column."""
    usable = lb.labelled_only(_last(labels, position))
    categories = lb.class_values(usable, "source_type")
    read = tx.extract_category(answers, "choices", categories, "source_type")
    truth = usable.groupBy("sample_id").agg(F.max("source_type").alias("label"))
    return ev.compare_predictions(read, truth, "sample_id", "category", "label")
