import random

from tagloom.llm import licenses


def test_every_different_line_teaches_or_calibrates(spark):
    rng = random.Random(5)
    lines = [f"line {i} " + " ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(1, 6))) for i in range(9_000)]
    texts = ["\n".join(lines[i : i + 60]) for i in range(0, 9_000, 60)]
    # the same lines again, notices, lines without words, no text
    texts += [texts[0], texts[1].upper(), "\n".join(max(n, key=len) for n in licenses.NOTICES.values()), "--\n\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.prose(docs).groupBy("teaches").count().collect()
    counts = {r["teaches"]: r["count"] for r in rows}
    assert sum(counts.values()) == 9_000
    assert min(counts.values()) > 4_000
    models, unseen = licenses.train(docs)
    assert unseen == counts[False]
    assert models.licence.numClasses == 2
    assert models.family.numClasses == len(licenses.NOTICES)


def test_limit_is_that_of_all_unseen_lines(spark):
    rng = random.Random(6)
    # of 20,000 lines these are likelier a licence than prose; some stand there often, some have taught
    above = [(f"w{i}", 0.3 + 0.7 * rng.random()) for i in range(50)]
    rows = above + above[:10] * 3 + [(None, 0.9999)] * 30
    table = spark.createDataFrame(rows, "unseen string, probability double")
    ranked = sorted([p for _, p in above] + [0.0] * (20_000 - 50))
    assert licenses.limit_of(table, 20_000) == ranked[19_980 - 1] > licenses.LEAST
    assert licenses.limit_of(table, 2_000_000) == licenses.LEAST
    assert licenses.limit_of(table.limit(0), 0) == licenses.LEAST
