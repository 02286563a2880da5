import contextlib
import datetime as dt
import decimal
import io
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import joins, labels, order


def plan(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain(True)
    return shown.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    return spark.range(30_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("key"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, skewed, how):
    right = spark.range(500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    plain = skewed.join(right, "key", how)
    spread = joins.spread_join(skewed, right, ["key"], how, min_rows=0)
    assert spread.columns == plain.columns
    assert sorted(spread.collect()) == sorted(plain.collect()) or how == "left" and sorted(
        map(str, spread.collect())
    ) == sorted(map(str, plain.collect()))


def test_spread_join_splits_the_hot_key(spark, skewed):
    right = spark.range(500).select(F.col("id").alias("key"))
    found = joins.spread_join(skewed, right, ["key"], min_rows=0)
    assert "__salt" in plan(found)
    # rows of the hot key end up in many partitions
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = joins.spread_join(skewed, right, ["key"], min_rows=0).filter("key = 0")
        parts = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert parts > 1


def test_parts_follow_the_share_of_a_key(spark, skewed):
    parts = joins._parts_per_key(skewed, ["key"], 0.01, 0.001)
    assert list(parts) == [512]  # a third of the rows, in parts of a thousandth
    assert len(parts[512]) == 1
    assert joins._parts_per_key(spark.range(1000), ["id"], 0.01, 0.001) == {}


def test_lookup_join_beyond_the_limit(spark, skewed):
    right = spark.range(500).select(F.col("id").alias("key"))
    small = joins.lookup_join(skewed, right, ["key"])
    large = joins.lookup_join(skewed, right, ["key"], max_rows=10)
    assert "strategy=broadcast" in plan(small)
    assert "strategy=broadcast" not in plan(large)
    assert sorted(small.collect()) == sorted(large.collect())


def test_fits_counts_rows_and_bytes(spark):
    df = spark.range(100).withColumn("t", F.lit("x" * 1000))
    assert joins.fits(df, 100, 10**6)
    assert not joins.fits(df, 99, 10**6)
    assert not joins.fits(df, 100, 10_000)


KEYS = {
    "double": lambda rng: rng.choice([rng.random() * 10 ** rng.randrange(-9, 9), -rng.random(), 0.0, 0.25, float("inf"), -float("inf"), None]),
    "decimal(9,3)": lambda rng: rng.choice([decimal.Decimal(rng.randrange(-999, 999)) / 100, None]),
    "timestamp": lambda rng: dt.datetime(1960, 1, 1) + dt.timedelta(seconds=rng.randrange(10**9)),
    "boolean": lambda rng: rng.choice([True, False, None]),
    "string": lambda rng: rng.choice([f"SAMN{rng.randrange(9999):04d}", "", None, "SAMN0001", "SAMN00010", "SAMN0001é", "ä"]),
    "date": lambda rng: rng.choice([dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(400)), None]),
    "int": lambda rng: 7,
}


@pytest.mark.parametrize("kind", list(KEYS))
def test_first_rows_equal_a_sort(spark, monkeypatch, kind):
    rng = random.Random(3)
    rows = [(i % 700, KEYS[kind](rng)) for i in range(1000)]
    rows += rows[:100]  # some rows three times over
    df = spark.createDataFrame(rows, f"id int, k {kind}").repartition(7)
    in_order = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    for size, error in ((20, order.RANK_ERROR), (20, 1e-9), (10_000, order.RANK_ERROR)):
        monkeypatch.setattr(order, "SORTED_ROWS", size)
        monkeypatch.setattr(order, "RANK_ERROR", error)  # far too small: borders must be moved apart
        for n in (0, 1, 150, 1099, 1100, 5000):
            want = sorted(in_order[:n], key=str)
            assert sorted(map(tuple, order.first_rows(df, F.col("k"), n, "id").collect()), key=str) == want
            flagged = order.first_rows_flag(df, F.col("k"), n, "in", "id").collect()
            assert sorted([(r["id"], r["k"]) for r in flagged if r["in"]], key=str) == want
            assert sorted([(r["id"], r["k"]) for r in flagged], key=str) == sorted(rows, key=str)
            assert all(r["in"] is not None for r in flagged)
    for n in (55, 300):  # without a tie column still exactly n
        assert labels.head(df, n, "k").count() == n
        assert labels.split_first_n(df, n, "k").filter("is_training").count() == n


def test_numbers_are_consecutive(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKET_BITS", 6)
    ids = spark.range(5000).union(spark.range(100))
    numbers = [r.n for r in order.numbered(ids, "id", "n").collect()]
    assert sorted(numbers) == list(range(5000))
    sizes = [r["count"] for r in labels.batch_ids(ids, "id", 300).groupBy("batch").count().collect()]
    assert sorted(sizes) == [200] + [300] * 16


def test_weights_balance_classes(spark, skewed):
    df = skewed.withColumn("c", F.when(F.col("id") < 27_000, "big").otherwise("small"))
    balanced = labels.weighted_sample(labels.class_weight(df, "c"), 2000, "weight", "id")
    counts = {r["c"]: r["count"] for r in balanced.groupBy("c").count().collect()}
    assert sum(counts.values()) == 2000
    assert 800 < counts["small"] < 1200
    favoured = labels.weighted_sample(labels.class_weight(df, "c", equal=False), 2000, "weight", "id")
    small = favoured.filter("c = 'small'").count()
    assert small < 100


def test_samples_repeat_and_do_not_depend_on_partitions(spark, skewed):
    a = labels.uniform_sample(skewed, 100, "id").collect()
    b = labels.uniform_sample(skewed.repartition(13), 100, "id").collect()
    assert sorted(a) == sorted(b)
    assert len({r.id for r in a}) == 100


def test_last_wins_and_missing(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "id string, pos int, v string")
    assert {tuple(r) for r in labels.last_wins(df, "id", "pos").collect()} == {("a", 2, None), ("b", 1, "y")}
    stored = spark.createDataFrame([("a",), (None,)], "id string")
    assert {r.id for r in labels.missing_records(df, stored, "id").collect()} == {"b"}
    assert labels.pending_prompts(df, stored, "id", force=True).count() == 3


def test_split_and_codes(spark, skewed):
    exact = labels.train_test_split(skewed, "id", exact=True)
    assert exact.filter("is_test").count() == 7500
    share = labels.train_test_split(skewed, "id").filter("is_test").count() / 30_000
    assert 0.24 < share < 0.26
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "l string")
    assert {tuple(r) for r in labels.encode_labels(df, "l").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_class_list_refuses_free_text(spark, skewed):
    assert labels.class_list(spark.createDataFrame([("b",), ("a",), (None,)], "source_type string")) == ["a", "b"]
    with pytest.raises(ValueError):
        labels.class_list(skewed, "id", max_classes=100)
