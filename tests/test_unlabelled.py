import random

from pyspark.sql import functions as F

from tagloom.operators import attributes, text, vectors
from tagloom.plans import unlabelled_clusters as uc


def test_clusters_follow_the_words(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        own = " ".join(f"kind{i % 3}word{rng.randrange(6)}" for _ in range(5))
        rows.append((i, own, f"kind{i % 3}place{rng.randrange(4)}", f"label{i % 3}"))
    rows += [(900, None, None, "label0"), (901, "", "", "label1")]
    records = spark.createDataFrame(rows, "id int, host string, place string, kind string").repartition(3)
    described = uc.record_vectors(records, ["host", "place"], "id", dimension=6, min_count=2)
    assert described.columns == ["id", "host", "place", "kind", "text", "vector"]
    placed = uc.cluster_records(described, "kind").persist()
    try:
        assert placed.count() == 241 and placed.select("cluster").distinct().count() == 3
        shares = uc.distribution(placed.filter("id < 900"), "kind").filter("n > 1")
        assert {r["label"]: r["share"] for r in shares.withColumnRenamed("kind", "label").collect()} == {f"label{k}": 1.0 for k in range(3)}
        lengths = placed.filter("id < 900").agg(F.min(vectors.fn.norm("vector")), F.max(vectors.fn.norm("vector"))).first()
        assert abs(lengths[0] - 1) < 1e-9 and abs(lengths[1] - 1) < 1e-9
    finally:
        placed.unpersist()


LEMMAS = [("running", "run"), ("sitting", "sit"), ("walking", "walk"), ("talking", "talk"), ("going", "go"), ("boxes", "box"), ("foxes", "fox"),
          ("cities", "city"), ("duties", "duty"), ("cats", "cat"), ("dogs", "dog"), ("pigs", "pig"), ("hens", "hen"), ("cows", "cow"), ("rats", "rat"), ("cups", "cup"), ("was", "be"), ("is", "be"), (None, "x")]


def by_hand(pairs, forms, longest=5):
    pairs = {(t, lem) for t, lem in pairs if t and lem}
    counts, all_ = {}, {}
    for t, lem in pairs:
        for n in range(1, longest + 1):
            if len(t) > n:
                all_[t[-n:]] = all_.get(t[-n:], 0) + 1
                if lem.startswith(t[:-n]):
                    key = (t[-n:], lem[len(t) - n:])
                    counts[key] = counts.get(key, 0) + 1
    rules = {}
    for suffix in all_:
        best = min(((-n, r) for (s, r), n in counts.items() if s == suffix), default=None)
        if best and -best[0] >= 2 and -best[0] >= 0.5 * all_[suffix]:
            rules[suffix] = best[1]
    out = []
    for f in forms:
        lemma = dict(sorted(pairs, reverse=True)).get(f)
        for n in range(longest, 0, -1):
            if lemma is None and len(f) > n and f[-n:] in rules:
                lemma = f[:-n] + rules[f[-n:]]
        out.append(lemma or f)
    return rules, out


def test_lemmas_of_words_that_were_never_listed(spark):
    lemmas = spark.createDataFrame(LEMMAS, "token string, lemma string")
    rules = text.learn_lemma_rules(lemmas)
    forms = ["hats", "horses", "barking", "bodies", "sun", "was", "ing", "s", "axes", "spinning", "cats", "hats"]
    want_rules, want = by_hand(LEMMAS, forms)
    assert {r["suffix"]: r["replacement"] for r in rules.collect()} == want_rules
    tokens = spark.createDataFrame([(i, f) for i, f in enumerate(forms)] + [(99, None)], "id int, token string")
    found = {r["id"]: r["token"] for r in text.lemmatise_by_rules(tokens, lemmas, rules).collect()}
    assert found == {**dict(enumerate(want)), 99: None}
    assert found[0] == "hat" and found[2] == "bark" and found[3] == "body" and found[5] == "be"
    assert text.learn_lemma_rules(lemmas.limit(0)).count() == 0


def test_columns_that_differ_only_in_case(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("b", None, 3, "y")], "id string, p int, q int, r string").toDF("id", "Species", "species", "kind")
    rows = {tuple(r) for r in attributes.to_long(df, "id", ["species", "Species"], keep=["kind"]).collect()}
    assert rows == {("a", "x", 0, "species", "2"), ("a", "x", 1, "Species", "1"), ("b", "y", 0, "species", "3")}
