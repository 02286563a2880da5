"""Register of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import ENGLISH_STOP_WORDS
from tagloom.session import ship, use_all_cores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The English list, and some words of the other languages of the test tables.
STOP_WORDS = (*ENGLISH_STOP_WORDS, "das", "de", "der", "die", "el", "et", "la", "le", "und")
SQL_STOP_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
SQL_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
SQL_STRIP = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A text table, spread over all cores when it is one small file."""
    return use_all_cores(table(spark, sf, name))


def accession(number: str):
    """Eight-digit accession from a number."""
    return F.concat(F.lit("SAMN"), F.lpad(F.col(number).cast("string"), 8, "0"))


def sql_hash(seed: int, column: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {column}::VARCHAR), 1, 13))::BIGINT"


def sql_uniform(seed: int, column: str) -> str:
    return f"(({sql_hash(seed, column)} + 1) / 4503599627370497.0::DOUBLE)"
