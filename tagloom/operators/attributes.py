"""From JSON records to attributes: parsing, profiling, long, map and wide form.

The long form (sample_id, pos, field, value) is the main one, because field names differ only in
case in real data and cannot all be columns. The wide form has the fields asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import CORE_FIELDS, FIELD_PREFIX, NULL_MARKERS, SOURCE_FIELDS
from tagloom.functions.arrays import once, unnest
from tagloom.functions.values import (
    as_column,
    as_json_array,
    first_present,
    is_null_marker,
    null_if_marker,
)

#: Stands behind a record while it is parsed.
_END = "end of the record"
_RECORD_SCHEMA = "`@accession` string, Attributes string"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}
_ATTRIBUTE_SCHEMA = (
    "array<struct<`@attribute_name`: string, `@harmonized_name`: string, `#text`: string>>"
)


def unwrap_envelope(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace a record by the one inside its ``BioSampleSet.BioSample`` envelope, if any."""
    inner = F.get_json_object(as_column(raw), "$.BioSampleSet.BioSample")
    return df.withColumn(raw, F.coalesce(inner, as_column(raw)))


def parse_records(df: DataFrame, raw: str = "raw", file_id: str | None = None) -> DataFrame:
    """Parse each record once: sample_id, attributes, problem.

    The id is the one in the record, or ``file_id`` when that column is given. ``problem`` is
    ``malformed`` (not one JSON object and nothing else) or ``no_id`` and null for a good record.
    ``attributes`` is null when the record has none.
    """
    text = as_column(raw)
    # One parse decides: a list of the record and an end mark has just these two entries, or something else is behind
    # the record. Texts that this parser refuses are looked at again below.
    wrapped = F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))
    record = once(df, "__record", F.try_parse_json(wrapped))
    whole = F.coalesce(F.try_variant_get("__record", "$[1]", "string") == _END, F.lit(False)) & _opens(text)
    record = record.withColumn("__whole", whole)
    attribute = "$[0].Attributes.Attribute"
    listed = F.coalesce(
        F.try_variant_get("__record", attribute, _ATTRIBUTE_SCHEMA),
        # a single attribute is no list
        F.array_compact(F.array(F.try_variant_get("__record", attribute, _ATTRIBUTE_SCHEMA[len("array<") : -1]))),
    )
    listed = F.when(F.size(listed) > 0, listed)
    body_id = F.try_variant_get("__record", "$[0]['@accession']", "string")
    other_id, other_listed, other_whole = _lenient(text)
    malformed = ~(F.col("__whole") | other_whole)
    sample_id = as_column(file_id) if file_id else F.when(F.col("__whole"), body_id).otherwise(other_id)
    attributes = F.transform(
        F.when(F.col("__whole"), listed).otherwise(other_listed),
        lambda a: F.struct(
            F.nullif(first_present(a["@harmonized_name"], a["@attribute_name"]), F.lit("")).alias(
                "field"
            ),
            a["#text"].alias("value"),
        ),
    )
    return record.select(
        *[as_column(c) for c in df.columns if c not in ("sample_id", "attributes", "problem")],
        sample_id.alias("sample_id"),
        attributes.alias("attributes"),
        F.when(malformed, "malformed")
        .when(sample_id.isNull() | (sample_id == ""), "no_id")
        .alias("problem"),
    )


def _opens(text: Column) -> Column:
    return F.ltrim(F.translate(text, "\n\r\t", "   ")).startswith("{")


def _lenient(text: Column) -> tuple[Column, Column, Column]:
    """Id, attributes and whether it is one object, by a parser that takes repeated names (the last counts) and NaN."""
    record = F.from_json(text, _RECORD_SCHEMA, _STRICT)
    # The parser stops at the end of the first value: whatever follows would spoil one of these.
    in_list = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    in_object = F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), "r string", _STRICT)
    whole = F.coalesce(F.size(in_list) == 1, F.lit(False)) & in_object["r"].isNotNull() & _opens(text)
    # No attributes may be written as an empty text, list or object too.
    inner = F.get_json_object(record["Attributes"], "$.Attribute")
    return record["@accession"], F.from_json(as_json_array(inner), _ATTRIBUTE_SCHEMA, _STRICT), whole


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNull()).drop("problem")


def bad_records(parsed: DataFrame) -> DataFrame:
    """Records set aside, with the reason; the rest of the job goes on without them."""
    return parsed.filter(F.col("problem").isNotNull())


def long_attributes(records: DataFrame) -> DataFrame:
    """One row per attribute. Nameless ones keep a null field."""
    return unnest(records, F.col("attributes"), ["sample_id"], "attribute", "pos").select(
        "sample_id", "pos", "attribute.field", "attribute.value"
    )


def field_dictionary(
    long: DataFrame, field: str = "field", sample_id: str = "sample_id"
) -> DataFrame:
    """Every field name with the smallest id that has it."""
    named = long.filter(as_column(field).isNotNull())
    return named.groupBy(as_column(field).alias("field")).agg(
        F.min(as_column(sample_id)).alias("first_seen")
    )


def attribute_map(records: DataFrame, name: str = "attrs") -> DataFrame:
    """Adds the attributes as a map; of a repeated field the last value counts.

    A record carries all its attributes, so this needs no shuffle.
    """
    named = F.filter(F.coalesce(F.col("attributes"), F.array()), lambda a: a["field"].isNotNull())
    staged = records.withColumn("__named", named).withColumn(
        "__fields", F.array_distinct(F.transform(F.col("__named"), lambda a: a["field"]))
    )
    last = F.transform(
        F.col("__fields"),
        lambda f: F.element_at(F.filter(F.col("__named"), lambda a: a["field"] == f), -1)["value"],
    )
    return staged.withColumn(name, F.map_from_arrays(F.col("__fields"), last)).drop(
        "__named", "__fields"
    )


def wide_attributes(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per record with attributes, one column per wanted field; no shuffle."""
    _check_names(records, fields)
    kept = attribute_map(records.filter(F.col("attributes").isNotNull()))
    return kept.select(
        "sample_id", *[F.try_element_at(F.col("attrs"), F.lit(f)).alias(f) for f in fields]
    )


def pivot_attributes(
    long: DataFrame,
    fields: Sequence[str],
    sample_id: str = "sample_id",
    field: str = "field",
    value: str = "value",
    pos: str = "pos",
) -> DataFrame:
    """The same from a long table: one row per id, the last value of a repeated field."""
    _check_names(long, fields)
    return (
        long.groupBy(as_column(sample_id).alias("sample_id"))
        .pivot(field, list(fields))
        .agg(F.max_by(as_column(value), as_column(pos)))
    )


def null_markers(
    df: DataFrame, columns: Iterable[str], markers: Iterable[str] = NULL_MARKERS
) -> DataFrame:
    """Set values that mean "nothing recorded" to null."""
    markers = list(markers)
    return df.withColumns({c: null_if_marker(c, markers) for c in columns})


def drop_null_markers(
    long: DataFrame, value: str = "value", markers: Iterable[str] = NULL_MARKERS
) -> DataFrame:
    """Long form of the same: rows without a value go."""
    return long.filter(as_column(value).isNotNull() & ~is_null_marker(value, markers))


def wanted_field(
    field: str | Column = "field",
    wanted: Iterable[str] = SOURCE_FIELDS,
    prefix: str | None = FIELD_PREFIX,
) -> Column:
    """True for a field on the list or starting with the prefix."""
    name = as_column(field)
    listed = name.isin(*list(wanted))
    return listed | name.startswith(prefix) if prefix else listed


def select_fields(
    df: DataFrame,
    field: str = "field",
    wanted: Iterable[str] = SOURCE_FIELDS,
    prefix: str | None = FIELD_PREFIX,
) -> DataFrame:
    """Rows of a field dictionary or of a long table whose field is wanted."""
    return df.filter(wanted_field(field, wanted, prefix))


def sparse_attrs(df: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Keep only the set entries of a map; a helper entry named ``index`` goes too."""
    return df.withColumn(
        attrs, F.map_filter(as_column(attrs), lambda k, v: v.isNotNull() & (k != "index"))
    )


def to_map(df: DataFrame, columns: Sequence[str], name: str = "attrs") -> DataFrame:
    """Put wide columns into one map column."""
    entries = []
    for c in columns:
        entries += [F.lit(c), as_column(c).cast("string")]
    return df.withColumn(name, F.create_map(*entries))


def to_long(
    df: DataFrame, sample_id: str, columns: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Put wide columns below each other; null cells are left out. Columns in ``keep`` stay.

    Columns are taken by their exact name, also where another differs from it only in case.
    """
    if len({c.lower() for c in df.columns}) < len(df.columns):
        # names that are clear whatever the session does with case
        places = [df.columns.index(c) for c in (sample_id, *columns, *keep)]
        plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        wide = F.array(
            *[F.struct(F.lit(c).alias("field"), F.col(f"c{i}").cast("string").alias("value")) for c, i in zip(columns, places[1:], strict=False)]
        )
        kept = [f"c{i}" for i in places[1 + len(columns) :]]
        long = unnest(plain, wide, [F.col(f"c{places[0]}").alias("sample_id"), *kept], "cell", "pos").filter("cell.value IS NOT NULL")
        return long.select("sample_id", *[F.col(c).alias(k) for c, k in zip(kept, keep, strict=True)], "pos", "cell.field", "cell.value")
    cells = F.array(
        *[F.struct(F.lit(c).alias("field"), as_column(c).cast("string").alias("value")) for c in columns]
    )
    kept = [as_column(c) for c in keep]
    long = unnest(df, cells, [as_column(sample_id).alias("sample_id"), *kept], "cell", "pos")
    return long.select("sample_id", *kept, "pos", "cell.field", "cell.value").filter(
        F.col("value").isNotNull()
    )


def core_columns(
    df: DataFrame, sample_id: str = "sample_id", fields: Sequence[str] = CORE_FIELDS
) -> DataFrame:
    """Place, position, date and host of every record."""
    return df.select(as_column(sample_id), *[as_column(f) for f in fields])


def row_counts(**frames: DataFrame) -> DataFrame:
    """Number of rows per named frame."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in frames.items()
    ]
    result = counted[0]
    for one in counted[1:]:
        result = result.unionAll(one)
    return result


def _check_names(df: DataFrame, fields: Sequence[str]) -> None:
    """Names that differ only in case cannot both be columns unless the session tells them apart."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return
    seen: dict[str, str] = {}
    for f in fields:
        if f.lower() in seen:
            raise ValueError(
                f"{seen[f.lower()]!r} and {f!r} differ only in case: choose one, use the long or "
                "map form, or set spark.sql.caseSensitive"
            )
        seen[f.lower()] = f
