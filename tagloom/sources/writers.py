"""Writers. Sharded outputs are rebalanced first, so that a large shard becomes several files
and a small one is not scattered over every task. Where the number of records in a file is given, a shard goes to
as many tasks as its files are worth.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import as_column, shard
from tagloom.sources.readers import PREDICTION_SCHEMA

#: Files that a task writes when the number of records in a file is given: their number costs time, not their bytes.
FILES_A_TASK = 64
_NOT_THERE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def write_attributes(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Wide attribute table as CSV with header."""
    _csv(df, path, ",", compression)


def write_fields(df: DataFrame, path: str) -> None:
    """Field dictionary (field, first_seen) as CSV; names with commas are quoted."""
    _csv(df.select("field", "first_seen"), path, ",", "none")


def write_report(df: DataFrame, path: str, sep: str = "\t", compression: str = "none") -> None:
    """Evaluation, comparison or accuracy table as separated text with header."""
    _csv(df, path, sep, compression)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    df.select(as_column(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_records(
    df: DataFrame,
    path: str,
    id_column: str = "sample_id",
    records_per_file: int | None = None,
    mode: str = "append",
) -> None:
    """Records as JSON lines in folders named by the start of the id.

    ``df`` has one row per id. Rows are added to what is stored, and an id that the store has keeps its
    record. ``mode="overwrite"`` replaces the store.
    """
    new = _new_only(df, path, id_column, "json", mode)
    writer = _sharded(new, id_column, records_per_file).write.mode(mode).partitionBy("shard")
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.json(path)


def write_raw_records(
    df: DataFrame,
    path: str,
    raw_column: str = "raw",
    id_column: str = "sample_id",
    records_per_file: int | None = None,
    mode: str = "append",
) -> None:
    """Record documents that are JSON text already, as ``*.txt`` in the same folders.

    Such files don't name their ids, so give only records that the store lacks (``missing_records``).
    """
    writer = _sharded(df, id_column, records_per_file).select("shard", as_column(raw_column).alias("value")).write
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.mode(mode).partitionBy("shard").text(path)


def write_prompts(
    df: DataFrame,
    path: str,
    id_column: str = "sample_id",
    prompt_column: str = "prompt",
    sharded: bool = True,
    mode: str = "append",
) -> None:
    """Prompts with their ids as Parquet, sharded like the records or flat; added as records are."""
    wanted = df.select(as_column(id_column).alias("sample_id"), as_column(prompt_column).alias("prompt"))
    new = _new_only(wanted, path, "sample_id", "parquet", mode)
    if sharded:
        _sharded(new, "sample_id").write.mode(mode).partitionBy("shard").parquet(path)
    else:
        new.write.mode(mode).parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Answers as JSON objects with their ids (columns of ``readers.PREDICTION_SCHEMA``); added as records are."""
    new = _new_only(df.select(*PREDICTION_SCHEMA.names), path, "sample_id", "json", mode)
    new.write.mode(mode).json(path)


def _new_only(df: DataFrame, path: str, id_column: str, form: str, mode: str) -> DataFrame:
    """Rows whose id is not stored at ``path`` yet."""
    if mode != "append":
        return df
    kind = df.schema[id_column].dataType.simpleString()
    try:
        known = df.sparkSession.read.format(form).schema(f"`{id_column}` {kind}").load(path)
    except AnalysisException as error:
        if error.getCondition() not in _NOT_THERE:
            raise
        return df
    return df.join(known.distinct(), id_column, "left_anti")


def create_or_load(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False
) -> DataFrame:
    """The table stored at ``path``; built and stored first when missing or on ``refresh``.

    Every build goes to a folder of its own below ``path`` and counts only once it is listed as ready, which is done
    after its last row is written. A build that breaks off leaves the table as it was, and readers of
    an older build are not disturbed.
    """
    ready = f"{path.rstrip('/')}/ready"
    if not refresh:
        try:
            builds = spark.read.schema("folder string, number long").parquet(ready)
        except AnalysisException as error:
            if error.getCondition() not in _NOT_THERE:
                raise
        else:
            last = builds.agg(F.max_by("folder", "number")).first()[0]
            if last:
                return spark.read.parquet(f"{path.rstrip('/')}/{last}")
    folder = f"build-{uuid.uuid4().hex}"
    build().write.parquet(f"{path.rstrip('/')}/{folder}")
    listed = spark.createDataFrame([(folder, time.time_ns())], "folder string, number long")
    listed.coalesce(1).write.mode("append").parquet(ready)
    return spark.read.parquet(f"{path.rstrip('/')}/{folder}")


def _sharded(df: DataFrame, id_column: str, records_per_file: int | None = None) -> DataFrame:
    placed = df.withColumn("shard", shard(id_column))
    if not records_per_file:
        return placed.hint("rebalance", "shard")
    most = F.lit(records_per_file * FILES_A_TASK)
    # a row per folder
    shards = placed.groupBy(F.col("shard").alias("__shard")).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts"))
    tasks = shards.agg(F.sum("__parts")).first()[0] or 1
    parted = placed.join(F.broadcast(shards), F.col("shard").eqNullSafe(F.col("__shard"))).withColumn(
        "__part", F.pmod(F.xxhash64(as_column(id_column)), F.col("__parts"))
    )
    return parted.repartition(tasks, "shard", "__part").drop("__shard", "__parts", "__part")


def _csv(df: DataFrame, path: str, sep: str, compression: str) -> None:
    df.write.mode("overwrite").csv(
        path,
        sep=sep,
        header=True,
        compression=compression,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def with_columns_as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays as bracketed text, so that they fit in a CSV cell."""
    return df.withColumns(
        {
            c: F.concat(
                F.lit("["), F.array_join(as_column(c).cast("array<string>"), " "), F.lit("]")
            )
            for c in columns
        }
    )
