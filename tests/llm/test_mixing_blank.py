from tagloom.llm import mixing


def test_a_source_of_blank_texts_is_taken_once(spark):
    rows = [(1, "a b c", "s"), (2, "d", "t"), (3, None, "blank"), (4, "", "blank"), (5, " \t\n ", "blank")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for options in ({"entropy": 0.95}, {"max_repeat": 1.5}, {"entropy": 0.95, "budget": 50}):
        found = mixing.mix(table, **options).collect()
        assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5}
        blank = [(r["doc_id"], r["epoch"], r["n_tokens"]) for r in found if r["source"] == "blank"]
        assert sorted(blank) == [(3, 0, 0), (4, 0, 0), (5, 0, 0)]
    assert mixing.mix(table.filter("source = 'blank'"), entropy=0.95).count() == 3
