import itertools
import random

import numpy as np
import pytest

from tagloom.operators import tagger as tg

PLACES = [a + b for a, b in itertools.product(["Nor", "Sel", "Kar", "Tem", "Bur", "Lan", "Wes", "Ost"], ["ville", "burg", "stad", "ham"])]
ANIMALS = [f"{a} {b}" for a, b in itertools.product(["red", "grey", "great"], ["finchox", "wolfox", "hawkox", "toadox"])]


def rows_of(n, places, animals, seed):
    rng = random.Random(seed)
    filler = "it was seen again last year by the old team and no one knew why".split()
    out = []
    for i in range(n):
        some = " ".join(rng.choice(filler) for _ in range(rng.randrange(2, 6)))
        out.append((i, f"The sample from {rng.choice(places)} was taken in May. A {rng.choice(animals)} lived there; {some}.\nNothing else {some}"))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    known_places, known_animals = PLACES[:20], ANIMALS[:8]
    gaz = spark.createDataFrame([(p, "PLACE") for p in known_places] + [(a, "ANIMAL") for a in known_animals], "term string, label string")
    docs = spark.createDataFrame(rows_of(400, known_places, known_animals, 1), "id long, t string").repartition(4)
    return tg.learn(docs, "id", "t", gaz, passes=5), docs, gaz


def test_finds_what_is_on_no_list(spark, learned):
    tagger, _, _ = learned
    assert tagger.labels == ["ANIMAL", "PLACE"]
    rows = rows_of(200, PLACES[20:], ANIMALS[8:], 2)
    docs = spark.createDataFrame(rows, "id long, t string")
    got = {(r.sample_id, r.term, r.label, r.start, r.end) for r in tg.tag_learned(docs, "id", "t", tagger).collect()}
    want = set()
    for i, t in rows:
        for terms, label in ((PLACES[20:], "PLACE"), (ANIMALS[8:], "ANIMAL")):
            want |= {(i, x.lower(), label, t.index(x), t.index(x) + len(x)) for x in terms if x in t}
    assert len(want) == 400
    right = len(got & want)
    assert right / len(want) > 0.9 and right / len(got) > 0.9


def test_learning_again_gives_the_same(spark, learned):
    tagger, docs, gaz = learned
    again = tg.learn(docs.repartition(7), "id", "t", gaz, passes=5)
    assert np.allclose(again.weights, tagger.weights) and np.allclose(again.steps, tagger.steps)


def test_examples_are_bounded(spark, learned):
    _, docs, gaz = learned
    drawn, labels = tg.examples(docs, "id", "t", gaz, most=100)
    told = [r for r in drawn.collect() if any(r["tags"])]
    assert 60 <= len(told) <= 140 and drawn.count() - len(told) <= 60
    assert all(len(r["words"]) == len(r["tags"]) for r in told)


def test_viterbi_against_every_path():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 1, 3])
    scores, steps = rng.normal(size=(3, 5, 3)), rng.normal(size=(4, 3)) + tg._allowed(1)
    found = tg.viterbi(scores, lengths, steps)
    for s, n in enumerate(lengths):
        def worth(path, s=s):
            return sum(scores[s, i, t] + steps[3 if i == 0 else path[i - 1], t] for i, t in enumerate(path))
        assert tuple(found[s, :n]) == max(itertools.product(range(3), repeat=int(n)), key=worth)


def test_spans_and_sentences():
    assert tg.spans([0, 1, 2, 2, 0, 3, 1, 2]) == [(1, 3, 0), (5, 5, 1), (6, 7, 0)]
    found = tg.sentences("One two. Three\nfour-five 6.5 x")
    assert [f[0] for f in found] == [["One", "two"], ["Three"], ["four", "five", "6", "5", "x"]]
    assert found[1][1:] == ([9], [14]) and tg.sentences("") == tg.sentences("...") == []
    assert [len(f[0]) for f in tg.sentences("w " * 130)] == [60, 60, 10]


def test_odd_texts(spark, learned):
    tagger, docs, gaz = learned
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "from Norville was"), (5, "x " * 50_000)], "id long, t string")
    assert {r.sample_id for r in tg.tag_learned(odd, "id", "t", tagger).collect()} <= {None, 5}
    assert tg.tag_learned(odd.limit(0), "id", "t", tagger).count() == 0
    nothing = tg.learn(docs.limit(0), "id", "t", gaz, passes=1)
    assert tg.tag_learned(docs, "id", "t", nothing).count() == 0
    no_terms = tg.learn(docs, "id", "t", gaz.limit(0), passes=1)
    assert no_terms.labels == [] and tg.tag_learned(docs, "id", "t", no_terms).count() == 0


def test_sentences_are_cut_a_few_texts_at_a_time(learned, monkeypatch):
    """The lists of a whole batch are never held; the examples are the same."""
    _, docs, gaz = learned
    key = lambda df: sorted((r["key"], tuple(r["words"]), tuple(r["tags"])) for r in df.collect())
    want = key(tg.examples(docs, "id", "t", gaz)[0])
    monkeypatch.setattr(tg, "TEXTS", 3)
    assert want and key(tg.examples(docs, "id", "t", gaz)[0]) == want


def test_learning_takes_all_sentences(learned, monkeypatch):
    """Each sentence lies in one shard, whether it has a mention or not; before, at most three in ten of those without one were taken."""
    _, docs, gaz = learned
    kept, keep = [], tg.stored
    monkeypatch.setattr(tg, "stored", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    monkeypatch.setattr(tg, "SHARD_CHARS", 4_000, raising=False)
    rare = gaz.filter("term = 'Norville'")
    tg.learn(docs, "id", "t", rare, passes=1)
    want = sorted(len(s[0]) for r in docs.collect() for s in tg.sentences(r["t"]))
    rows = kept[0].collect()
    got = sorted(n for r in rows for n in np.frombuffer(r["lengths"], np.int32))
    assert got == want and len(rows) == len({r["shard"] for r in rows}) > tg.SHARDS


def test_shards_that_learn_beside_each_other_learn_as_alone(learned, monkeypatch):
    """How many shards a task takes at once changes nothing."""
    tagger, docs, gaz = learned
    monkeypatch.setattr(tg, "HELD", 1)
    alone = tg.learn(docs, "id", "t", gaz, passes=5)
    assert np.allclose(alone.weights, tagger.weights) and np.allclose(alone.steps, tagger.steps)
