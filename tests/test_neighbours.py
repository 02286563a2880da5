import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import neighbours as nb
from tagloom.operators import vectors

SCHEMA = "id int, v array<double>"


@pytest.fixture(scope="module")
def clouds(spark):
    """Thirty clouds; a third of the rows are copies of one vector."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(30, 24))
    rows = [(i, (middles[i % 30] + 0.25 * rng.normal(size=24)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[4][1]) for i in range(700)] + [(5000, [0.0] * 24), (5001, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def asked(df):
    return df.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))


def triples(df):
    return sorted((r.query_id, r.rank, r.vector_id, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("pieces", [(8192, 1024), (50, 30)])
def test_all_cells_give_the_exact_answer(clouds, monkeypatch, pieces):
    monkeypatch.setattr(nb, "PIECE_VECTORS", pieces[0])
    monkeypatch.setattr(nb, "PIECE_QUERIES", pieces[1])
    known = clouds.filter("v IS NOT NULL AND id < 5000")
    queries = asked(known.filter("id % 20 = 0"))
    index = nb.build_index(clouds, "id", "v", cells=12)
    assert index.vectors.count() == 2201  # all but the null one
    found = nb.search_index(index, queries, 4, probes=12, exclude_same_id=True)
    exact = vectors.nearest_neighbours(known.union(clouds.filter("id = 5000")), queries, 4, "id", "v", exclude_same_id=True)
    got, want = triples(found), triples(exact)
    # copies of one vector are equally similar up to the last bits, so their ids may differ
    assert [(q, r, s) for q, r, _, s in got] == [(q, r, s) for q, r, _, s in want]


def test_recall_at_the_number_of_cells_that_was_chosen(clouds):
    known = clouds.filter("id < 1500")
    index = nb.build_index(known, "id", "v")
    assert len(index.centres) == 38
    queries = asked(known)
    probes = nb.probes_for(index, queries, 3, exclude_same_id=True)
    assert 1 <= probes < 38
    exact = vectors.nearest_neighbours(known, queries, 3, "id", "v", exclude_same_id=True)
    row = nb.recall_of(nb.search_index(index, queries, 3, probes, exclude_same_id=True), exact).first()
    assert row["queries"] == 1500 and row["recall"] >= 0.9


def test_planted_neighbours_are_found_in_few_cells(spark, clouds):
    known = clouds.filter("id < 1500")
    moved = known.select((F.col("id") + 10_000).alias("query_id"), F.transform("v", lambda x: x + 1e-4).alias("query_vector"))
    found = nb.search_index(nb.build_index(known, "id", "v"), moved, 1, probes=3).collect()
    assert sorted((r.query_id, r.vector_id) for r in found) == [(i + 10_000, i) for i in range(1500)]


def test_odd_tables(spark, clouds):
    empty = spark.createDataFrame([], SCHEMA)
    index = nb.build_index(empty, "id", "v")
    assert nb.search_index(index, asked(clouds.limit(3)), 2, 5).count() == 0
    assert nb.probes_for(index, asked(empty), 2) == 1
    one = nb.build_index(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], SCHEMA), "id", "v")
    both = spark.createDataFrame([(7, [1.0, 2.0]), (8, None), (9, [0.0, 0.0])], SCHEMA)
    found = triples(nb.search_index(one, asked(both), 2, 3))
    assert found == [(7, 1, 1, 1.0), (7, 2, 2, 1.0), (9, 1, 1, 0.0), (9, 2, 2, 0.0)]
    assert nb.search_index(nb.build_index(clouds, "id", "v", cells=5), asked(empty), 2, 2).count() == 0


def test_a_query_goes_once_to_each_shelf(clouds, monkeypatch):
    """Not once to each of its cells, with its vector each time."""
    known = clouds.filter("id < 1500")
    index = nb.build_index(known, "id", "v", cells=30)
    queries = known.select(F.col("id").alias("query_id"), "v").select("query_id", F.col("v").alias("vector"))
    sizes = {r["cell"]: r["count"] for r in index.vectors.groupBy("cell").count().collect()}
    shelf_of, pieces = nb._shelves(sizes, 30)
    assert set(shelf_of[list(sizes)]) == {0} and pieces == [1]
    rows = nb._asked(queries, index.centres, 20, shelf_of).collect()
    assert len(rows) == 1500 and all(len(r.cells) == len(set(r.cells)) <= 20 for r in rows)
    monkeypatch.setattr(nb, "PIECE_VECTORS", 500)
    shelf_of, pieces = nb._shelves({0: 300, 1: 150, 2: 1700, 4: 500, 5: 1}, 6)
    assert shelf_of.tolist() == [0, 0, 1, -1, 2, 3] and pieces == [1, 4, 1, 1]


def test_shelves_change_no_neighbours(clouds, monkeypatch):
    known = clouds.filter("id < 2400")
    index = nb.build_index(known, "id", "v", cells=30)
    queries = asked(known.filter("id % 7 = 0"))
    whole = triples(nb.search_index(index, queries, 4, 6))
    for name, n in (("PIECE_VECTORS", 200), ("PIECE_QUERIES", 40), ("STEP_QUERIES", 9)):
        monkeypatch.setattr(nb, name, n)
    cut = triples(nb.search_index(index, queries, 4, 6))
    assert [(q, r, s) for q, r, _, s in cut] == [(q, r, s) for q, r, _, s in whole]
