import gzip
import json

import pytest
from pyspark.sql import functions as F

from tagloom.constants import TABLE_NA_STRINGS
from tagloom.operators import attributes as at
from tagloom.session import scratch_path
from tagloom.sources import readers, writers


def test_labels_from_gzip(spark, tmp_path):
    path = tmp_path / "labels.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("Name\tSample ID\tSource Type\tSource Niche\nx\tSAMN1\tHuman\tHuman\ny\t\tAvian\tPoultry\n")
    rows = [tuple(r) for r in readers.read_labels(spark, str(path)).collect()]
    assert rows == [("SAMN1", "Human", "Human"), (None, "Avian", "Poultry")]


def test_attribute_table_keeps_text_as_it_is(spark):
    path = scratch_path(spark, "wide")
    rows = [("a", 'say "hi", you', "line\nbreak", "NA"), ("b", " padded ", None, "2020")]
    df = spark.createDataFrame(rows, "`Sample ID` string, `IFSAC+ Category` string, note string, x string")
    writers.write_attributes(df, path)
    assert sorted(readers.read_attributes(spark, path).collect()) == sorted(df.collect())
    with_na = readers.read_attributes(spark, path, na_values=TABLE_NA_STRINGS)
    assert {r["Sample ID"]: r["x"] for r in with_na.collect()} == {"a": None, "b": "2020"}


def test_records_two_folders_deep(spark, tmp_path):
    shard = tmp_path / "SAMN0001"
    shard.mkdir()
    (shard / "SAMN0001.v1.txt").write_text(json.dumps({"@accession": "SAMN0001"}, indent=4))
    (shard / "notes.md").write_text("no record")
    (tmp_path / "top.txt").write_text("{}")
    (shard / "deeper").mkdir()
    (shard / "deeper" / "deep.txt").write_text("{}")
    rows = readers.read_records(spark, str(tmp_path)).collect()
    assert [r.file_id for r in rows] == ["SAMN0001"]
    assert at.parse_records(readers.read_records(spark, str(tmp_path))).first().sample_id == "SAMN0001"


def test_xml_one_or_many_attributes(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<BioSampleSet><BioSample accession="S1"><Attributes><Attribute attribute_name="Host" '
        'harmonized_name="host">pig</Attribute></Attributes></BioSample>'
        '<BioSample accession="S2"><Attributes><Attribute attribute_name="age">2</Attribute>'
        '<Attribute attribute_name="sex">f</Attribute></Attributes></BioSample>'
        '<BioSample accession="S3"/></BioSampleSet>'
    )
    records = readers.read_record_xml(spark, str(tmp_path / "r.xml"))
    assert records.count() == 3
    rows = sorted((r.sample_id, r.field, r.value) for r in at.long_attributes(records).collect())
    assert rows == [("S1", "host", "pig"), ("S2", "age", "2"), ("S2", "sex", "f")]


def test_predictions_take_the_id_from_the_file(spark, tmp_path):
    (tmp_path / "SAMN7.json").write_text(json.dumps({"sample_id": "other", "model": "m", "choices": "Human", "tokens": 5, "prompt": "p"}))
    row = readers.read_predictions(spark, str(tmp_path)).first()
    assert (row.sample_id, row.choices, row.tokens) == ("SAMN7", "Human", 5)
    assert readers.read_predictions(spark, str(tmp_path), id_from_file=False).first().sample_id == "other"


def test_places_with_blank_line_and_gaps(spark, tmp_path):
    (tmp_path / "places").write_text("\nNA\t-22.9\t18.4\tNamibia\nUM\t\t\tIslands\n")
    rows = {r.code: (r.lat, r.lon, r.name) for r in readers.read_geo_lookup(spark, str(tmp_path / "places")).collect()}
    assert rows == {"NA": (-22.9, 18.4, "Namibia"), "UM": (None, None, "Islands")}


def test_create_or_load(spark):
    path = scratch_path(spark, "stored")
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert writers.create_or_load(spark, path, lambda: build(3)).count() == 3
    assert writers.create_or_load(spark, path, lambda: build(5)).count() == 3
    assert writers.create_or_load(spark, path, lambda: build(5), refresh=True).count() == 5
    assert built == [3, 5]


def test_a_build_that_breaks_off_leaves_the_table(spark):
    path = scratch_path(spark, "stored")

    def broken():
        return spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))

    with pytest.raises(Exception, match="broken"):
        writers.create_or_load(spark, path, broken)
    # nothing is ready yet, whatever parts were written
    assert writers.create_or_load(spark, path, lambda: spark.range(3)).count() == 3
    old = writers.create_or_load(spark, path, lambda: spark.range(9))
    with pytest.raises(Exception, match="broken"):
        writers.create_or_load(spark, path, broken, refresh=True)
    assert writers.create_or_load(spark, path, lambda: spark.range(9)).count() == 3
    assert writers.create_or_load(spark, path, lambda: spark.range(5), refresh=True).count() == 5
    assert old.count() == 3


def test_other_read_errors_are_not_hidden(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        writers.create_or_load(spark, str(tmp_path / "x.parquet"), lambda: spark.range(1)).collect()
    assert (tmp_path / "x.parquet").read_text() == "not parquet"


def test_prompts_and_lines(spark):
    path = scratch_path(spark, "prompts")
    df = spark.createDataFrame([("SAMN00010001", "a\nb"), ("SAMN00020001", "c")], "sample_id string, prompt string")
    writers.write_prompts(df, path)
    rows = {r.sample_id: (str(r.shard), r.prompt) for r in spark.read.parquet(path).collect()}
    assert rows == {"SAMN00010001": ("SAMN0001", "a\nb"), "SAMN00020001": ("SAMN0002", "c")}
    flat = scratch_path(spark, "flat")
    writers.write_prompts(df, flat, sharded=False)
    assert spark.read.parquet(flat).count() == 2
    lines = scratch_path(spark, "lines")
    writers.write_lines(df, "sample_id", lines)
    assert {r.value for r in spark.read.text(lines).collect()} == {"SAMN00010001", "SAMN00020001"}


def test_stores_grow_and_keep_their_ids(spark):
    for write, read in (
        (writers.write_records, lambda p: spark.read.json(p).select("sample_id", "prompt")),
        (writers.write_prompts, lambda p: spark.read.parquet(p).select("sample_id", "prompt")),
    ):
        path = scratch_path(spark, "store")
        frame = lambda *rows: spark.createDataFrame(list(rows), "sample_id string, prompt string")
        write(frame(("SAMN00010001", "a")), path)
        write(frame(("SAMN00010001", "changed"), ("SAMN00020001", "b")), path)
        assert sorted(map(tuple, read(path).collect())) == [("SAMN00010001", "a"), ("SAMN00020001", "b")]
        write(frame(("SAMN00030001", "c")), path, mode="overwrite")
        assert [tuple(r) for r in read(path).collect()] == [("SAMN00030001", "c")]


def test_names_that_differ_in_case(spark, tmp_path):
    folder = tmp_path / "table.csv"
    folder.write_text('sample_id,Species,species,"odd, name"\nS1,a,b,"x\ny"\nS2,NA,,z\n')
    df = readers.read_attributes(spark, str(folder), na_values=["NA"])
    assert df.columns == ["sample_id", "Species", "species", "odd, name"]
    assert [tuple(r) for r in df.collect()] == [("S1", "a", "b", "x\ny"), ("S2", None, None, "z")]


def test_a_large_shard_becomes_several_files(spark):
    path = scratch_path(spark, "skew")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        ids = spark.range(20_000).selectExpr("if(id % 3 = 0, concat('SAMN0000', id), concat('SAMN', 10000 + id % 9, id)) AS sample_id", "md5(string(id)) AS v")
        writers.write_records(ids, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    files = spark.read.json(path).select("shard", "_metadata.file_name").distinct().groupBy("shard").count()
    counts = {r["shard"]: r["count"] for r in files.collect()}
    assert counts["SAMN0000"] > 1
    assert spark.read.json(path).count() == 20_000


def test_streaming_frames_take_the_row_functions(spark, tmp_path):
    df = spark.createDataFrame([("a", "Missing"), ("b", "pig")], "id string, host string")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    cleaned = at.null_markers(stream, ["host"])
    q = cleaned.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("cleaned").collect()} == {("a", None), ("b", "pig")}


def test_one_file_per_record_is_the_work_of_many_tasks(spark, tmp_path, monkeypatch):
    """A folder whose files are small but many was written by one task."""
    monkeypatch.setattr(writers, "FILES_A_TASK", 10)
    path = str(tmp_path / "records")
    ids = spark.range(120).select(F.format_string("Supplier#%09d", "id").alias("sample_id"), F.col("id").cast("string").alias("raw"))
    odd = spark.createDataFrame([("Other", "a"), (None, "b"), (None, "c"), ("Supplier#000000001", "1")], "sample_id string, raw string")
    writers.write_raw_records(ids.coalesce(1).union(odd.coalesce(1)), path, records_per_file=1)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    rows = readers.read_records(spark, path).collect()
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert sorted(r.raw.rstrip("\n") for r in rows) == sorted([*map(str, range(120)), "a", "b", "c", "1"])
    tasks = {r.file_id.split("-")[1] for r in rows}
    assert len(tasks) > 5
    # a small folder is one task's work
    few = str(tmp_path / "few")
    writers.write_records(ids.limit(40).repartition(8).withColumn("k", F.lit(1)), few, records_per_file=20)
    assert spark.read.text(few).select(F.input_file_name()).distinct().count() == 2
