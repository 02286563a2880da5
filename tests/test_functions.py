import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import arrays, hashing, text, values


def one(spark, column, **cells):
    row = [tuple(cells.values())] if cells else [("x",)]
    df = spark.createDataFrame(row, [*cells] or ["x"])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [("[\n  test\n]", "test"), ("a\nb", "ab"), ("\t a [b]  ", "a b"), ("", ""), ("[]", "")],
)
def test_clean_value(spark, raw, clean):
    assert one(spark, text.clean_value("c"), c=raw) == clean


def test_null_markers_ignore_case_but_not_blanks(spark):
    df = spark.createDataFrame([("Missing",), ("NOT COLLECTED",), (" missing ",), ("pig",), (None,)], "c string")
    got = [r["r"] for r in df.select(values.null_if_marker("c").alias("r")).collect()]
    assert got == [None, None, " missing ", "pig", None]


@pytest.mark.parametrize(
    "written, year, month, day",
    [
        ("2020", 2020, None, None),
        ("2020-05", 2020, 5, None),
        ("2020-05-11", 2020, 5, 11),
        ("11-May-2020", 2020, 5, 11),
        ("May-2020", 2020, 5, None),
        ("2018-07-11T00:00:00.000", 2018, 7, 11),
        ("missing", None, None, None),
        ("2020-13-40", 2020, None, None),
    ],
)
def test_partial_dates(spark, written, year, month, day):
    df = spark.createDataFrame([(written,)], "d string")
    row = df.select(
        values.collection_year("d"), values.collection_month("d"), values.collection_day("d")
    ).first()
    assert tuple(row) == (year, month, day)


def test_names_places_ids(spark):
    assert one(spark, values.country_part("c"), c="USA:NC") == "USA"
    assert one(spark, values.region_part("c"), c="USA: NC") == "NC"
    assert one(spark, values.region_part("c"), c="USA") is None
    assert one(spark, values.numeric_id("c"), c="SAMN09638057") == 9638057
    assert one(spark, values.numeric_id("c"), c="none") is None
    assert one(spark, values.base_name("c"), c="/a/b.c/SAMN1.json.gz") == "SAMN1"
    assert one(spark, values.shard("c"), c="SAMN09638057") == "SAMN0963"
    assert one(spark, values.part("c", "::", 1), c="a:: b") == " b"
    assert one(spark, values.part("c", "::", 1), c="a") is None
    assert one(spark, values.round_half_even(F.lit(2.5))) == 2.0


def test_ontology_terms(spark):
    got = one(spark, values.ontology_terms("c"), c="pig:FOODON_1| gut:UBERON_2, loose |")
    assert [tuple(t) for t in got] == [("pig", "FOODON_1"), ("gut", "UBERON_2"), ("loose", None)]


def test_object_or_array(spark):
    assert one(spark, values.as_json_array("c"), c='{"a":1}') == '[{"a":1}]'
    assert one(spark, values.as_json_array("c"), c=' [{"a":1}]') == ' [{"a":1}]'


def test_prompt_and_payload(spark):
    prompt = one(spark, text.prompt("c", ["Human", "Swine"]), c="host:pig")
    assert prompt.endswith("Host categories:\nHuman,Swine\n::\nhost:pig.")
    assert one(spark, text.prompt_payload("c"), c=prompt) == " host:pig."
    assert one(spark, text.prompt_payload("c"), c="no separator") is None


@pytest.mark.parametrize(
    "reply, category",
    [
        ("Human", "Human"),
        ("Human.", "Human"),
        ('The record should be assigned to the "Human" category.', "Human"),
        ('The record should be assigned to the category "Meat".', "Meat"),
    ],
)
def test_answer_category(spark, reply, category):
    assert one(spark, text.answer_category("c"), c=reply) == category


def test_render_skips_nulls_and_keeps_order(spark):
    df = spark.createDataFrame([("pig", None, "gut")], "host string, age string, `body site` string")
    row = df.select(
        text.render_pairs(["host", "age", "body site"]), text.render_values(["body site", "age", "host"])
    ).first()
    assert tuple(row) == ("host:pig,body site:gut", "gut,pig")


def test_ngrams_stop_at_null_words(spark):
    df = spark.createDataFrame([(["a", "b", None, "c", "d"],)], "w array<string>")
    got = df.select(text.ngrams("w", 1, 3).alias("g")).first()["g"]
    assert sorted(got) == ["a", "a b", "b", "c", "c d", "d"]


def test_hash_is_the_md5_prefix(spark):
    import hashlib

    want = int(hashlib.md5(b"7:42").hexdigest()[:13], 16)
    assert one(spark, hashing.stable_hash(7, F.lit(42))) == want
    assert 0 < one(spark, hashing.uniform(7, F.lit(42))) <= 1


def test_vectors(spark):
    assert one(spark, arrays.parse_vector("c"), c="[1 2,\n 3e-1]") == [1.0, 2.0, 0.3]
    assert one(spark, arrays.parse_vector("c"), c="[]") == []
    assert one(spark, arrays.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, arrays.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, arrays.distance(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 2.0
    assert one(spark, arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 50), max_size=300), min_size=1, max_size=5))
def test_starts_from_lengths(spark, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "i int, l array<int>")
    got = {r["i"]: r["s"] for r in df.select("i", arrays.starts_from_lengths("l").alias("s")).collect()}
    for i, lengths in enumerate(lists):
        assert got[i] == list(itertools.accumulate([0, *lengths]))[: len(lengths)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1_é ß.-\nЖ漢", max_size=60), min_size=1, max_size=8))
def test_tokens_and_pieces(spark, written):
    df = spark.createDataFrame(list(enumerate(written)), "i int, t string")
    rows = df.select("i", text.tokens("t").alias("w"), text.pieces("t").alias("p")).collect()
    for r in rows:
        assert r["w"] == re.findall(r"\w{2,}", written[r["i"]].lower())
        assert "".join(r["p"]) == written[r["i"]]


def test_days_that_no_month_has(spark):
    texts = ["99-May-2020", "31-Feb-2020", "29-Feb-2020", "29-Feb-2019", "0-May-2020", "7-May-2020", "2020-02-30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(values.collection_day("t")).collect()] == [None, None, 29, None, None, 7, None]
