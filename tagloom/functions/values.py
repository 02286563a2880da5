"""Functions on single values: null markers, names, places, dates, ids, ontology terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.constants import NULL_MARKERS, SHARD_LENGTH, STRIP_CHARACTERS, UNKNOWN

ColumnOrName = Column | str


def as_column(c: ColumnOrName) -> Column:
    """A name becomes a column of exactly that name, also when it holds dots or spaces."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(as_column(c), F.lit(STRIP_CHARACTERS))


def is_null_marker(c: ColumnOrName, markers: Iterable[str] = NULL_MARKERS) -> Column:
    """True for a value that stands for "nothing recorded"; case is ignored, blanks are not."""
    return F.lower(as_column(c)).isin(*[m.lower() for m in markers])


def null_if_marker(c: ColumnOrName, markers: Iterable[str] = NULL_MARKERS) -> Column:
    c = as_column(c)
    return F.when(~is_null_marker(c, markers), c)


def default_unknown(c: ColumnOrName, default: str = UNKNOWN) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(default))


def first_present(*columns: ColumnOrName) -> Column:
    """The first name that is set, e.g. the harmonised name or else the submitted one."""
    return F.coalesce(*[as_column(c) for c in columns])


def part(c: ColumnOrName, separator: str, index: int) -> Column:
    """Piece ``index`` of a split at a literal separator; null when there are fewer pieces."""
    return F.get(F.split(as_column(c), rf"\Q{separator}\E"), F.lit(index))


def shard(c: ColumnOrName, length: int = SHARD_LENGTH) -> Column:
    """Leading characters of an id, used as folder name."""
    return F.substring(as_column(c), 1, length)


def base_name(path: ColumnOrName) -> Column:
    """File name without folders and without anything from the first dot on."""
    return F.regexp_extract(as_column(path), r"([^/.]*)[^/]*\z", 1)


def round_half_even(c: ColumnOrName, scale: int = 0) -> Column:
    return F.bround(as_column(c), scale)


def is_json_array(c: ColumnOrName) -> Column:
    """Tells an array from a single object in JSON text."""
    return F.ltrim(as_column(c)).startswith("[")


def as_json_array(c: ColumnOrName) -> Column:
    """Give JSON text array shape: a single object becomes an array of one."""
    c = as_column(c)
    return F.when(is_json_array(c), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))


def country_part(c: ColumnOrName) -> Column:
    """``USA:NC`` -> ``USA``; null when empty."""
    return _filled(F.get(F.split(as_column(c), ":", 2), F.lit(0)))


def region_part(c: ColumnOrName) -> Column:
    """``USA:NC`` -> ``NC``; null without a region."""
    return _filled(F.get(F.split(as_column(c), ":", 2), F.lit(1)))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def collection_year(c: ColumnOrName) -> Column:
    """Year of a full or partial date (``2020``, ``2020-05``, ``11-May-2020``)."""
    return _number(F.regexp_extract(as_column(c), r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1))


def collection_month(c: ColumnOrName) -> Column:
    """Month of a full or partial date, null when only the year is known."""
    c = as_column(c)
    numeric = _number(F.regexp_extract(c, r"(?:^|[^0-9])[0-9]{4}[-/]([0-9]{1,2})(?:[^0-9]|$)", 1))
    name = F.lower(F.substring(F.regexp_extract(c, r"([A-Za-z]{3,9})(?:[- /,]|$)", 1), 1, 3))
    # position in "janfebmar...": 1, 4, 7, ... -> 1, 2, 3, ...
    position = F.position(name, F.lit("".join(_MONTHS)))
    named = F.when(
        (F.length(name) == 3) & (position > 0) & (position % 3 == 1),
        ((position + 2) / 3).cast("int"),
    )
    return F.when(numeric.between(1, 12), numeric).otherwise(named)


def collection_day(c: ColumnOrName) -> Column:
    """Day of a full date, null for a partial or impossible one."""
    c = as_column(c)
    iso = F.try_to_date(
        F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^0-9]|$)", 1), "yyyy-MM-dd"
    )
    named = _number(F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{1,2})[- ][A-Za-z]{3,9}[- ,]", 1))
    # A day that its month doesn't have gives no date.
    year = F.lpad(collection_year(c).cast("string"), 4, "0")
    parts = [year, *[F.lpad(x.cast("string"), 2, "0") for x in (collection_month(c), named)]]
    real = F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
    return F.coalesce(F.dayofmonth(iso), F.when(F.dayofmonth(real) == named, named))


def numeric_id(c: ColumnOrName) -> Column:
    """Digits at the end of an accession as a number (``SAMN09638057`` -> 9638057)."""
    return F.regexp_extract(as_column(c), r"([0-9]+)\z", 1).try_cast("bigint")


def ontology_terms(c: ColumnOrName) -> Column:
    """``pig:FOODON_1| gut:UBERON_2`` -> array of (label, ontology_id), blanks dropped."""
    pieces = F.filter(F.split(as_column(c), r"\s*[|,]\s*"), lambda x: F.trim(x) != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            F.trim(F.regexp_replace(x, r":[A-Za-z]+_[0-9]+\s*\z", "")).alias("label"),
            _filled(F.regexp_extract(x, r":([A-Za-z]+_[0-9]+)\s*\z", 1)).alias("ontology_id"),
        ),
    )


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _number(c: Column) -> Column:
    return c.try_cast("int")
