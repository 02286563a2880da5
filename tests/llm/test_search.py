import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import search


def terms(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def by_hand(texts, queries, k=10):
    """Every text against every query: (query id, rank, text id, score)."""
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in texts]
    found = [x for x in found if x[2]]
    n, total = len(found), sum(s for *_, s in found)
    held = Counter(t for _, c, _ in found for t in c)
    out = []
    for query, text in queries:
        scores = []
        for i, c, size in found:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(query, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, frame.collect()), key=str)


ITEMS = [(1, "w1 w2 w3 w7 w1 x5"), (2, "the same SAME a b"), (3, None), (4, ""), (5, "日本語 の é, ü!"), (1, "w5 w9"), (None, "a b"), (6, "nowhere"),
         (7, " ".join(f"w{k}" for k in range(40)))]


@pytest.mark.parametrize("texts,postings", [(1 << 15, 1 << 20), (1, 1), (7, 200)])
def test_against_every_pair(spark, documents, odd_documents, monkeypatch, texts, postings):
    monkeypatch.setattr(search, "TEXTS", texts)
    monkeypatch.setattr(search, "POSTINGS", postings)
    items = spark.createDataFrame([(*i, 1, 2) for i in ITEMS], "item_id long, text string, score int, doc_id int")
    assert got(search.search(documents, items)) == by_hand(odd_documents, ITEMS)


def test_ties_repeats_and_lists_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 2)
    rng = random.Random(5)
    texts = [(i % 90, " ".join(f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(6))) for i in range(300)]
    texts += [(500 + i, "t1 t2 t3") for i in range(200)] + [(None, "t1 t2 t3")] * 3
    items = [(q, " ".join(f"t{rng.randrange(30)}" for _ in range(8))) for q in range(9)] + [(20, "t1 t2 t3")]
    frames = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((texts, "doc_id"), (items, "item_id"))]
    for k in (1, 10, 2000):
        assert got(search.search(frames[0].repartition(7), frames[1], k)) == by_hand(texts, items, k)


def test_empty_tables(spark, documents, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(search.search(no_documents, items)) == []
    assert got(search.search(documents, items.limit(0))) == []
    assert got(search.search(documents, items.filter("item_id in (3, 4)"))) == []


def test_terms_at_every_character():
    text = "".join(map(chr, range(1, 0x250))) + "aÉb C_D 1.5 x’y  z 😀"
    codes, first = search.term_codes(pa.array([text, None, "É É"]))
    assert np.diff(first).tolist() == [len(terms(text)), 0, 2]
    assert len(set(codes[: first[1]].tolist())) == len(set(terms(text))) and codes[-1] == codes[-2]


def test_few_accumulators_and_exact_scores():
    """Rare terms decide: texts with frequent terms only get no accumulator."""
    rng = random.Random(8)
    texts = [f"common other {'rare' if i % 200 == 0 else 'usual'} f{rng.randrange(50)}" for i in range(4000)]
    codes, first = search.term_codes(pa.array(["common other rare"]))
    vocabulary = np.sort(codes)
    found, starts = search.term_codes(pa.array(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    term = np.minimum(np.searchsorted(vocabulary, found), 2)
    listed = vocabulary[term] == found
    block = search._Block()
    block.add(pa.array(range(len(texts)), pa.int64()), np.diff(starts), owner[listed], term[listed], np.ones(listed.sum(), np.int64))
    shard = search.Shard(block.row().to_pylist()[0], len(texts), len(found), 3)
    top = search.Top(10)
    weights = {codes[0]: 1, codes[1]: 1, codes[2]: 5000}
    rare_first = np.searchsorted(vocabulary, codes[::-1])
    created = shard.search(rare_first, np.array([weights[c] for c in codes[::-1]]), top, 10)
    assert created == 20 and top.ids.tolist() == [i * 200 for i in range(10)]
    assert len(set(top.scores.tolist())) == 1
    # nothing of another block that can't reach what is found already
    assert shard.search(rare_first[1:], np.array([1, 1]), top, 10) == 0
