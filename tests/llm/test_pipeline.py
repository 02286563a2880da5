"""The stages on the smallest tables, each against what it promises for its own input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import jaccard, mixing
from tagloom.llm.queries import ORACLES, QUERIES
from tagloom.llm.shared import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        found[name] = docs
    return found


def test_columns_and_names(results):
    names = list(results)
    assert names[1:] == ["toxicity", "line_dedup", "jaccard_dedup", "source_mixing", "packing"]
    for name in names[1:-1]:
        assert results[name].columns == results["input"].columns


def test_toxic_documents_go(spark, results):
    """The smallest table has a dozen toxic labels, too few for every rare word."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    number = lambda docs, toxic: docs.join(labels.filter(f"toxic = {toxic}"), "doc_id").count()
    assert number(results["toxicity"], 1) <= 0.5 * number(results["input"], 1)
    assert number(results["toxicity"], 0) >= 0.97 * number(results["input"], 0)


def test_lines_and_copies(results):
    before, after = results["toxicity"], results["line_dedup"]
    assert after.filter("n_chars <> length(text)").count() == 0
    assert after.join(before.filter("trim(text) <> ''"), "doc_id", "left_anti").count() == 0
    groups = jaccard.jaccard_groups(after, 5, 80)
    kept = results["jaccard_dedup"]
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in groups.collect()}
    assert jaccard.jaccard_groups(kept, 5, 80).filter("n_links > 0").count() == 0


def test_mixture_and_sequences(results):
    docs, mixed, packed = (results[n] for n in ("jaccard_dedup", "source_mixing", "packing"))
    assert mixed.select("doc_id").distinct().count() == docs.count()
    per = lambda d: {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum(mixing.tokens("text")).alias("n")).collect()}
    had, has = per(docs), per(mixed)
    times = [has[s] / had[s] for s in had if had[s]]
    assert max(times) < 2.5 and min(times) >= 1
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n > 1024 or n <> end").count() == 0
    assert packed.filter("piece = 0").count() == mixed.count()


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_operators_read_their_whole_table(spark, name):
    found = QUERIES[name](spark, SF)
    if name in ("op6_license_scan", "op9_packing"):
        assert found.count() > 0
    else:
        keys = {"op8": ("embeddings", "vec_id"), "op12": ("embeddings", "vec_id"), "op13": ("pages", "page_id"), "op11": ("benchmark", "item_id")}
        table, key = keys.get(name.split("_")[0], ("documents", "doc_id"))
        want = spark.read.parquet(f"{SF}/{table}.parquet")
        assert found.select(key).distinct().count() == want.select(key).distinct().count()


def test_held_out_languages(spark):
    found = QUERIES["op2_language_id"](spark, SF).filter("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert found.join(docs, "doc_id").filter("lang <> lang_pred").count() <= 0.02 * found.count() + 1
