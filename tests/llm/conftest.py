import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, set long, line string, family string"


def prose(rng, n, common=40):
    """Words of invented prose, some of them frequent."""
    return [f"w{rng.randrange(common)}" if rng.random() < 0.4 else f"x{rng.randrange(100_000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_documents():
    """Rows with every oddity: nulls, empty and long texts, exact and near copies, repeated rows and ids."""
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [" ".join(prose(rng, rng.randrange(1, 200))) for _ in range(30)]
    for k in range(25):  # near copies of all degrees
        words = list(base)
        for _ in range(k // 3):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    texts += [texts[3]] * 4 + [texts[5].upper()]
    texts += ["", " \t\n ", "a", "a b", "A b", "one\ttwo\nthree  four", "1 2 3!", "é è ü Ü ß", "日本語 の 文"]
    texts += ["\n".join([" ".join(base[:20])] * 3), " ".join(prose(rng, 30_000)), " ".join(["same"] * 500)]
    texts += [" ".join(prose(rng, 40)) + " " + " ".join(base[30:60]) + " " + " ".join(prose(rng, 40)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(2000, None), (None, texts[0]), (None, None), (7, texts[7]), (8, "another text of the same id here")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, odd_documents):
    """The odd rows as a table with more columns, some of them named like the operators' own."""
    langs, sources = ["en", "de", None], ["s0", "s1", None, "s2"]
    rows = [
        (i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), k, -k, f"line {k}", "f")
        for k, (i, t) in enumerate(odd_documents)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
