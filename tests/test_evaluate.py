import pytest
from pyspark.sql import functions as F

from tagloom.operators import evaluate as ev
from tagloom.operators import text as tx
from tagloom.plans import few_shot_tagger, prompt_agreement


def test_vote_ties_and_records_without_tags(spark):
    tags = spark.createDataFrame(
        [("r1", "b", 0.9), ("r1", "a", 0.5), ("r2", "b", 0.2), ("r2", "b", 0.4), ("r2", "a", 0.9), ("r3", None, 0.1)],
        "id string, predicted string, score double",
    )
    records = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "id string")
    rows = {r.id: (r.predicted, r.votes, r.score) for r in ev.majority_vote(tags, records, "id", score="score").collect()}
    assert rows["r1"] == ("a", 1, 0.5)
    assert rows["r2"][:2] == ("b", 2) and rows["r2"][2] == pytest.approx(0.3)
    assert rows["r3"] == rows["r4"] == ("Unknown", 0, None)


def test_unmatched_predictions_are_counted_apart(spark):
    predictions = spark.createDataFrame([("a", "Human"), ("b", "Swine"), ("c", "Human")], "id string, predicted string")
    truth = spark.createDataFrame([("a", "Human"), ("b", "Bovine")], "id string, label string")
    compared = ev.compare_predictions(predictions, truth, "id")
    assert {r.id: (r.truth, r.passed) for r in compared.collect()} == {
        "a": ("Human", True), "b": ("Bovine", False), "c": (None, False)
    }
    assert tuple(ev.pass_rate(compared).first()) == (1, 3, 1, 33.0)
    assert tuple(ev.pass_rate(compared.filter("false")).first()) == (0, 0, 0, None)


def test_report_against_hand_counts(spark):
    pairs = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "a")] + [("c", "a")] * 2
    df = spark.createDataFrame(pairs, "t string, p string")
    rows = {r["class"]: r for r in ev.classification_report(df, "t", "p").collect()}
    assert rows["a"].precision == pytest.approx(6 / 9) and rows["a"].recall == pytest.approx(6 / 8)
    assert rows["b"].precision == pytest.approx(3 / 5) and rows["b"].support == 4
    assert (rows["c"].precision, rows["c"].recall, rows["c"].f1, rows["c"].support) == (0, 0, 0, 2)
    assert rows["accuracy"].f1 == pytest.approx(9 / 14)
    assert rows["macro avg"].recall == pytest.approx((6 / 8 + 3 / 4) / 3)
    assert rows["weighted avg"].precision == pytest.approx((6 / 9 * 8 + 3 / 5 * 4) / 14)


def test_replies_with_and_without_extra_words(spark):
    rows = [
        ("1", "Human", 'The record should be assigned to the "Human" host category.'),
        ("2", "Bovine", "Meat"),
        ("3", "Swine", "Swine"),
        ("4", "ND/Others", "Poultry"),
        ("5", "Poultry", 'The record can be assigned to the "Avian" category.'),
    ]
    df = spark.createDataFrame(rows, "sample_id string, source_type string, choices string")
    allowed = spark.createDataFrame([(c,) for c in ("Human", "Meat", "Swine", "Avian")], "category string")
    read = tx.extract_category(df, "choices", allowed)
    truth = df.select("sample_id", F.col("source_type").alias("label"))
    compared = ev.compare_predictions(read, truth, "sample_id", "category")
    judged = ev.outcome(compared, F.col("is_allowed"))
    assert {r.outcome: r.n for r in ev.result_outcomes(judged, "outcome").collect()} == {
        "pass": 2, "differs": 2, "fail": 1
    }


def test_tag_sets(spark):
    long = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "x")], "label string, value string")
    assert sorted(tuple(r) for r in ev.tags_by_class(long, "label").collect()) == [("a", "x"), ("b", "x")]


def test_evaluate_tags(spark):
    scores = spark.createDataFrame(
        [("r1", 0, "a", 0.1), ("r1", 0, "b", 0.7), ("r1", 1, "a", 0.4), ("r1", 1, "b", 0.4), ("r1", 2, "b", 0.5)],
        "id string, tag int, label string, score double",
    )
    records = spark.createDataFrame([("r1", "b"), ("r2", "a")], "id string, truth string")
    rows = {r.id: r for r in ev.evaluate_tags(scores, records, "id", "tag", "label", "score", "truth").collect()}
    assert rows["r1"].predicted == "b" and rows["r1"].passed and rows["r1"].score == pytest.approx(0.6)
    assert rows["r2"].predicted == "Unknown" and rows["r2"].score is None and not rows["r2"].passed


RECORDS = [
    ("s1", "pig gut", "farm", "Swine"), ("s2", "pig ear", None, "Swine"), ("s3", "human blood", "clinic", "Human"),
    ("s4", "human stool", "clinic", "Human"), ("s5", "pig", "farm", "Swine"), ("s6", "human", None, "Human"),
    ("s7", None, None, "Human"), ("s8", "yak", "clinic", "Bovine"),
]


def test_tagger_from_few_examples(spark):
    df = spark.createDataFrame(RECORDS, "id string, source string, place string, kind string")
    training, testing = few_shot_tagger.split(df, 4, "id")
    assert training.count() == 4 and testing.count() == 4
    tagger = few_shot_tagger.train(training, ["source", "place"], "id", "kind")
    rows = {r.sample_id: (r.predicted, r.passed) for r in tagger.evaluate(testing).collect()}
    assert rows["s5"] == ("Swine", True) and rows["s6"] == ("Human", True)
    assert rows["s7"] == ("Unknown", False) and rows["s8"][1] is False
    again = {r.sample_id: r.passed for r in tagger.evaluate(training).collect()}
    assert all(again.values())


def test_prompt_workflow_leaves_answered_prompts_alone(spark):
    labels = spark.createDataFrame([("s1", "Swine", "Livestock"), ("s3", "Human", "Human"), ("s9", None, None)],
                                   "sample_id string, source_type string, source_niche string")
    attrs = spark.createDataFrame([("s1", "pig", "missing"), ("s3", "Homo sapiens", "blood"), ("s4", "x", "y")],
                                  "sample_id string, host string, tissue string")
    prompts = prompt_agreement.prompts(labels, attrs, 10, ["host", "tissue"])
    shown = {r.sample_id: r.prompt for r in prompts.collect()}
    assert set(shown) == {"s1", "s3"} and shown["s1"].endswith("::\nhost:pig.")
    assert "Human,Swine" in shown["s3"]

    def scorer(batch):
        return batch.assign(model="m", choices='It is "Swine".', tokens=1)[
            ["sample_id", "model", "choices", "tokens", "prompt"]
        ]

    stored = spark.createDataFrame([("s3",)], "sample_id string")
    answers = prompt_agreement.answer_pending(prompts, stored, scorer)
    rows = prompt_agreement.agreement(answers, labels).collect()
    assert [(r.sample_id, r.category, r.truth, r.passed) for r in rows] == [("s1", "Swine", "Swine", True)]
    assert prompt_agreement.answer_pending(prompts, stored, scorer, force=True).count() == 2
