"""Records -> field dictionary, attribute tables and a list of bad records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tagloom.operators import attributes as at
from tagloom.sources.writers import create_or_load


@dataclass(frozen=True)
class AttributeTables:
    records: DataFrame
    bad: DataFrame
    long: DataFrame
    fields: DataFrame

    def wide(self, fields: Sequence[str]) -> DataFrame:
        """One column per wanted field, one row per record with attributes."""
        return at.wide_attributes(self.records, fields)


def build(raw: DataFrame, store: str, id_from_file: bool = False, refresh: bool = True) -> AttributeTables:
    """Parse every record once and keep the result at ``store``; all tables read from there.

    ``raw`` has the columns file_id and raw.
    """
    def parse() -> DataFrame:
        opened = at.unwrap_envelope(raw)
        return at.parse_records(opened, file_id="file_id" if id_from_file else None)

    parsed = create_or_load(raw.sparkSession, store, parse, refresh)
    records = at.good_records(parsed).select("sample_id", "attributes")
    long = at.long_attributes(records)
    return AttributeTables(records, at.bad_records(parsed), long, at.field_dictionary(long))
