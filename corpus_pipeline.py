"""A training corpus from documents: screen, clean lines, drop near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` applies them in turn, writing each result and reading it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import jaccard, lines, mixing, packing, toxicity
from tagloom.llm.queries import tokenizer_path
from tagloom.llm.shared import ship, small_batches, stored


def screen_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are more likely toxic than not (operator 7), whatever their label says.

    The model learns from the documents of this stage that ``labels`` covers.
    """
    small_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = [c for c in docs.columns]
    inner = docs.select(*[F.col(c).alias(f"c{i}") if c != "text" else F.col(c) for i, c in enumerate(own)])
    graded = toxicity.grade(inner, model).filter("p_toxic < 0.5")
    return graded.select(*[F.col(f"c{i}" if c != "text" else c).alias(c) for i, c in enumerate(own)])


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand on many sites but for their first occurrence (operator 4).

    A document that loses its last word this way goes; one that had none before stays.
    """
    cleaned = lines.remove_lines(docs, names=("_n_lines", "_n_removed"))
    kept = cleaned.filter((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("_n_removed") > 0, size).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike by 0.8 or more one stays: that of smallest id
    in each group of linked ones (operator 5). Documents without words all stay."""
    linked = jaccard.jaccard_groups(docs, length=5, percent=80)
    gone = linked.filter("component_id <> doc_id").select("doc_id")
    # Both grow with the corpus.
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Even out the sources (operator 3): the flattest weights for which no source is repeated more than 1.5
    times as often as another. Every document is taken at least once."""
    return mixing.mixed_documents(docs, max_repeat=1.5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 1024 (operator 9): a row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", screen_toxicity),
    ("line_dedup", clean_lines),
    ("jaccard_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
