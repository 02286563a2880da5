import re

import pytest

from tagloom.constants import CATEGORY_SCHEME
from tagloom.operators import enrich, sieve, terms, text


def test_assemble_skips_missing_fields(spark):
    df = spark.createDataFrame([("[soil]\n", "env", None), (None, None, None)], "a string, b string, c string")
    rows = [r.text for r in text.assemble_text(df, ["a", "b", "c"]).collect()]
    assert sorted(rows) == ["", "soil env"]
    assert text.drop_empty_text(text.assemble_text(df, ["a"])).count() == 1


def test_out_of_list_answer_is_flagged(spark):
    answers = spark.createDataFrame([("a", "Poultry"), ("b", 'Choose "Avian".'), ("c", None)], "id string, reply string")
    allowed = spark.createDataFrame([("Avian",), ("Human",)], "category string")
    rows = {r.id: (r.category, r.is_allowed) for r in text.extract_category(answers, "reply", allowed).collect()}
    assert rows == {"a": ("Poultry", False), "b": ("Avian", True), "c": (None, False)}


def test_unknown_defaults(spark):
    df = spark.createDataFrame([("pig", None)], "host string, city string")
    row = text.fill_unknown(df, ["host", "city", "country"]).first()
    assert (row.host, row.city, row.country) == ("pig", "Unknown", "Unknown")


def test_lemmas_and_unknown_words(spark):
    tokens = spark.createDataFrame([(1, "cows"), (1, "pig")], "id int, token string")
    lemmas = spark.createDataFrame([("cows", "cow")], "token string, lemma string")
    assert {r.token for r in text.lemmatise(tokens, lemmas).collect()} == {"cow", "pig"}
    docs = spark.createDataFrame([("a", "pig pig cow"), ("b", "yak")], "g string, t string")
    known = spark.createDataFrame([("pig",), ("pig",)], "token string")
    rows = {r.g: (r.words, r.unrecognised) for r in text.unrecognised_share(docs, "t", "g", known).collect()}
    assert rows == {"a": (3, 1), "b": (1, 1)}


def test_hosts_by_either_name(spark):
    names = enrich.host_names(spark)
    df = spark.createDataFrame([("turkey",), ("SUS  scrofa domesticus",), ("n/a",), (None,), ("Water",)], "host string")
    rows = {r.host: (r.common_name, r.scientific_name) for r in enrich.standardise_host(df, names, "host").collect()}
    assert rows["turkey"] == ("Turkey", "Meleagris gallopavo")
    assert rows["SUS  scrofa domesticus"] == ("Domestic pig", "Sus scrofa domesticus")
    assert rows["n/a"] == rows[None] == (None, None)
    assert rows["Water"] == ("Water", None)


def test_scheme(spark):
    scheme = enrich.category_scheme(spark)
    assert scheme.count() == sum(len(v) for v in CATEGORY_SCHEME.values())
    df = spark.createDataFrame([("Poultry", "Avian"), ("Poultry", "Swine"), (None, "Avian")], "niche string, kind string")
    assert [r.in_scheme for r in sorted(enrich.niche_check(df, scheme, "niche", "kind").collect(), key=str)] != []
    rows = {(r.niche, r.kind): r.in_scheme for r in enrich.niche_check(df, scheme, "niche", "kind").collect()}
    assert rows == {("Poultry", "Avian"): True, ("Poultry", "Swine"): False, (None, "Avian"): False}


def test_places_keep_own_values(spark):
    df = spark.createDataFrame([(1, "FR", 48.0), (2, "FR", None), (3, "XX", None)], "id int, country string, lat double")
    places = spark.createDataFrame([("FR", 46.2, 2.2), ("NA", -22.9, 18.4)], "country string, lat double, lon double")
    rows = {r.id: (r.lat, r.lon) for r in enrich.geo_backfill(df, places, "country").collect()}
    assert rows == {1: (48.0, 2.2), 2: (46.2, 2.2), 3: (None, None)}


@pytest.fixture(params=["trie", "join"])
def tagging(request, monkeypatch):
    """Both ways to find listed terms."""
    if request.param == "join":
        monkeypatch.setattr(enrich, "TRIE_TERMS", -1)


def test_mentions_against_brute_force(spark, tagging):
    listed = [("fever", "SIGN"), ("yellow fever", "DISEASE"), ("río grande", "PLACE"), ("of the nile", "PLACE")]
    texts = [
        "Yellow  fever; yellow fever, FEVER.",
        "Río Grande — río\ngrande of the Nile",
        "feverish, yellowfever",
        "",
        "…fever",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    gaz = spark.createDataFrame(listed, "term string, label string")
    got = {tuple(r) for r in enrich.tag_entities(docs, "id", "t", gaz).collect()}
    want = set()
    for i, t in enumerate(texts):
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t)]
        for n in (1, 2, 3):
            for j in range(len(words) - n + 1):
                run = " ".join(w[0] for w in words[j : j + n])
                want |= {(i, run, lab, words[j][1], words[j + n - 1][2]) for term, lab in listed if term == run}
    assert got == want and len(got) >= 7


def test_terms_with_marks_and_many_words(spark, tagging):
    listed = ["ready-to-eat food", "Soil/Dust", "food", "one two three four five", "...", "soil dust"]
    docs = spark.createDataFrame([(1, "Ready to eat food, soil / dust."), (2, "one two, three four-five"), (3, None)], "id int, t string")
    gaz = spark.createDataFrame([(t, "X") for t in listed], "term string, label string")
    got = {(r.sample_id, r.term, r.start, r.end) for r in enrich.tag_entities(docs, "id", "t", gaz).collect()}
    assert got == {
        (1, "ready-to-eat food", 0, 17), (1, "food", 13, 17), (1, "soil/dust", 19, 30), (1, "soil dust", 19, 30),
        (2, "one two three four five", 0, 24),
    }
    assert enrich.tag_entities(docs, "id", "t", gaz.limit(0)).count() == 0


def test_a_long_list_fills_the_sieve(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BITS", 1 << 10)  # 8,000 first words fill it
    monkeypatch.setattr(enrich, "TRIE_TERMS", 100)
    words = [f"w{i}" for i in range(8_000)]
    gaz = spark.createDataFrame([(f"{w} end", "X") for w in words], "term string, label string")
    docs = spark.createDataFrame([(1, "w17 end w18 other w7999 end v1 end")], "id int, t string")
    assert {r.term for r in enrich.tag_entities(docs, "id", "t", gaz).collect()} == {"w17 end", "w7999 end"}


def test_trie_finds_every_mention_and_the_longest():
    trie = terms.TermTrie([(["a", "b"], 0), (["a"], 1), (["b", "c", "d"], 2), (["a", "b"], 3), ([], 4)])
    words = "a b c d a b".split()
    assert sorted(trie.find(words)) == [(0, 0, 1), (0, 1, 0), (0, 1, 3), (1, 3, 2), (4, 4, 1), (4, 5, 0), (4, 5, 3)]
    assert terms.longest(trie.find(words)) == [(0, 1, 0), (4, 5, 0)]
    assert list(trie.find([])) == [] and terms.cut("Río  GRANDE-2") == (["río", "grande", "2"], [0, 5, 12], [3, 11, 13])


def test_many_mentions_leave_in_batches(spark, monkeypatch, tagging):
    monkeypatch.setattr(enrich, "BATCH_MENTIONS", 10)
    docs = spark.createDataFrame([(i, "x y " * (i % 30)) for i in range(200)], "id long, t string")
    gaz = spark.createDataFrame([("x", "A"), ("x", "B"), ("y x", None), (None, "C")], "term string, label string")
    rows = enrich.tag_entities(docs, "id", "t", gaz).collect()
    want = sum(2 * (i % 30) + max(0, i % 30 - 1) for i in range(200))
    assert len(rows) == want and {r.label for r in rows} == {"A", "B", None}
