import pytest

from tagloom.operators import attributes as at
from tagloom.plans import attribute_table
from tagloom.session import scratch_path

RECORDS = [
    ("f1", '{"@accession":"S1","Attributes":{"Attribute":{"@attribute_name":"host","#text":"pig"}}}'),
    (
        "f2",
        '{"@accession":"S2","Attributes":{"Attribute":['
        '{"@attribute_name":"Host","@harmonized_name":"host","#text":"pig"},'
        '{"@attribute_name":"host","#text":"cow"},{"#text":"nameless"},'
        '{"@attribute_name":"Species","#text":"A"},{"@attribute_name":"species","#text":"b"},'
        '{"@attribute_name":"Isolate, name or label","#text":"x"}]}}',
    ),
    ("f3", "{bad"),
    ("f4", '{"a":1}'),
    ("f5", '{"@accession":"S5"}'),
    ("f6", '{"BioSampleSet":{"BioSample":{"@accession":"S6","Attributes":'
           '{"Attribute":[{"@attribute_name":"age","#text":"2"}]}}}}'),
    ("f7", '{"@accession":"S7","Attributes":{"Attribute":[{"@attribute_name":"other","#text":"z"}]}}'),
]


@pytest.fixture(scope="module")
def tables(spark):
    raw = spark.createDataFrame(RECORDS, "file_id string, raw string")
    return attribute_table.build(raw, scratch_path(spark, "records"))


def test_one_attribute_or_many(tables):
    rows = {(r.sample_id, r.pos, r.field, r.value) for r in tables.long.collect()}
    assert ("S1", 0, "host", "pig") in rows
    assert {r for r in rows if r[0] == "S2" and r[2] == "host"} == {
        ("S2", 0, "host", "pig"), ("S2", 1, "host", "cow")
    }


def test_bad_records_are_set_aside(tables):
    assert {(r.file_id, r.problem) for r in tables.bad.collect()} == {
        ("f3", "malformed"), ("f4", "no_id")
    }


def test_names_differing_in_case_and_commas_stay_apart(tables):
    fields = {r.field: r.first_seen for r in tables.fields.collect()}
    assert fields["Species"] == fields["species"] == "S2"
    assert fields["Isolate, name or label"] == "S2"
    assert fields["host"] == "S1"
    assert None not in fields


def test_wide_last_value_wins_and_envelope_is_opened(tables):
    rows = {r.sample_id: (r.host, r.age) for r in tables.wide(["host", "age"]).collect()}
    # a record without the wanted fields stays, one without attributes goes
    assert rows == {"S1": ("pig", None), "S2": ("cow", None), "S6": (None, "2"), "S7": (None, None)}


def test_wide_equals_pivot(tables):
    fields = ["host", "age", "Species"]
    wide = {tuple(r) for r in tables.wide(fields).collect()}
    pivot = {tuple(r) for r in at.pivot_attributes(tables.long, fields).collect()}
    assert wide == pivot


def test_colliding_columns_are_refused(tables):
    with pytest.raises(ValueError, match="differ only in case"):
        tables.wide(["Species", "species"])


def test_id_from_file(spark):
    raw = spark.createDataFrame(RECORDS, "file_id string, raw string")
    tables = attribute_table.build(raw, scratch_path(spark, "records"), id_from_file=True)
    assert {r.sample_id for r in tables.records.collect()} == {"f1", "f2", "f4", "f5", "f6", "f7"}


def test_select_fields_and_markers(spark):
    long = spark.createDataFrame(
        [("a", 0, "host", "pig"), ("a", 1, "host_age", "Missing"), ("a", 2, "strain", "x"),
         ("a", 3, "IFSAC+ Category", "food"), ("a", 4, "collected_by", "me")],
        "sample_id string, pos int, field string, value string",
    )
    kept = at.drop_null_markers(at.select_fields(long))
    assert {r.field for r in kept.collect()} == {"host", "IFSAC+ Category"}


def test_sparse_attrs(spark):
    df = spark.createDataFrame([("a", "pig", None, 1)], "id string, host string, age string, index int")
    attrs = at.sparse_attrs(at.to_map(df, ["host", "age", "index"])).first()["attrs"]
    assert attrs == {"host": "pig"}


def test_only_one_whole_json_object_is_a_record(spark):
    good = ['{"@accession":"S1","Attributes":""}', '{"@accession":"S2","Attributes":[]}', ' {"@accession":"S3"}\n',
            '{"@accession":"S4","Attributes":{"Attribute":{"@attribute_name":"a","#text":"[1]} {"}}}']
    bad = ['{"@accession":"S1"} garbage', "{'@accession':'S1'}", '{"@accession":"S1"', "", "[]", '{"@accession":"S1"}][{"b":1}',
           '{"@accession":"S1"},"y":{"a":1}', '[{"@accession":"S1"}]', "5", '"text"']
    df = spark.createDataFrame([(t,) for t in good + bad], "raw string")
    parsed = at.parse_records(df).collect()
    assert {r.raw for r in parsed if r.problem is None} == set(good)
    assert {r.sample_id: len(r.attributes or []) for r in parsed if r.problem is None} == {"S1": 0, "S2": 0, "S3": 0, "S4": 1}
    assert {r.raw for r in parsed if r.problem == "malformed"} == set(bad)
