import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import languages, licenses, lines, mixing, packing, toxicity

LETTERS = {"xx": "abcdefg", "yy": "fghijkl", "zz": "éèçüöß"}


def sample_texts(spark, n=60):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        lang = list(LETTERS)[k % 3]
        words = ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(1, 60))]
        rows.append((k, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark, documents, no_documents):
    table = sample_texts(spark)
    prototypes = languages.learn(table.filter("doc_id % 2 = 0"))
    assert list(prototypes) == ["xx", "yy", "zz"]
    found = languages.identify(table, prototypes).join(table, "doc_id").filter("doc_id % 2 = 1")
    assert found.filter("lang_pred = lang").count() >= 28
    odd = {(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify(documents, prototypes).collect()}
    assert {(2000, "und", 0.0), (None, "und", 0.0)} <= odd and all(0 <= s <= 1 for _, _, s in odd)
    assert languages.identify(no_documents, prototypes).count() == 0
    assert languages.learn(no_documents) == {}
    assert languages.identify(documents, {}).filter("lang_pred <> 'und'").count() == 0


def test_profile_is_the_bundle_of_bound_letters():
    found, some = languages.profiles(["ab", "1 2", ""])
    assert some.tolist() == [True, False, False] and not found[1:].any()
    letters = {c: languages._letter(ord(c), languages.DIMENSIONS) for c in " ab"}
    want = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in (" ab", "ab "))
    assert np.allclose(found[0], want / np.linalg.norm(want), atol=1e-6)
    assert (languages.profiles(["AB,  ab!"])[0] == languages.profiles(["ab ab"])[0]).all()


def line_rows():
    rows = [(i, f"s{i % 12}", f"own {i}\n shared line \n\nrare {i % 3}\n" + ("twice\ntwice\r" if i % 6 == 0 else "tail")) for i in range(36)]
    return rows + [(100, "s1", None), (101, "s1", ""), (102, None, "shared line\nx"), (None, "s5", "shared line"), (103, "s0", "shared line"), (0, "s0", rows[0][2])]


def test_line_removal(spark, no_documents):
    rows = line_rows()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, n_removed long, line long")
    sites, first = {}, {}
    for i, s, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip():
                sites.setdefault(line.strip(), set()).update({s} - {None})
                first[line.strip()] = min(first.get(line.strip(), (i, p)), (i, p))
    spread = {x for x, s in sites.items() if len(s) >= 10}
    assert "shared line" in spread and "tail" in spread and "rare 1" not in spread
    want = []
    for i, _, t in rows:
        gone = set()
        for p, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip() in spread and first[line.strip()] != (i, p):
                gone.add(p)
        left = t if not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        want.append((i, left, 0 if t is None else len(t.split("\n")), len(gone)))
    removed = lines.remove_lines(table)
    assert removed.columns == ["doc_id", "source", "text", "line", "n_lines", "n_removed"]
    found = removed.select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert lines.remove_lines(no_documents).count() == 0
    clashing = table.withColumns({c: F.lit(1) for c in ("n_lines", "row", "places", "site", "place", "first", "about")})
    again = lines.remove_lines(clashing).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, again), key=str) == sorted(want, key=str)
    all_gone = {r["doc_id"]: r["text"] for r in lines.remove_lines(table, keep_first=False).collect()}
    assert all_gone[103] == ""


def test_near_threshold_sites_are_exact(spark):
    rows = [(k * 100 + s, f"s{s}", f"line {k}") for k in range(8, 13) for s in range(k)]
    table = lines.lines_of(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted(r["n_sites"] for r in lines.spread_lines(table).collect()) == [10, 11, 12]


def test_mixing(spark, documents, no_documents):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "hot" if rng.random() < 0.6 else rng.choice("abc")) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    share = {s: n / sum(total.values()) for s, n in total.items()}

    def entropy(a):
        p = np.array([x**a for x in share.values()])
        p /= p.sum()
        return -(p * np.log(p)).sum() / np.log(len(p))

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.95 else (low, mid)
    found = mixing.mix(table, entropy=0.95, budget=3000).collect()
    assert abs(found[0]["exponent"] - low) < 1e-6
    weight = {s: x**low for s, x in share.items()}
    weight = {s: w / sum(weight.values()) for s, w in weight.items()}
    dealt = Counter()
    for r in found:
        dealt[r["source"]] += r["n_tokens"]
        assert abs(r["weight"] - weight[r["source"]]) < 1e-6
    for s, w in weight.items():
        assert 0 <= dealt[s] - round(w * 3000) < 30
    times = Counter((r["doc_id"], r["copy"]) for r in found)
    for s in total:  # each whole permutation comes before the next begins
        own = [times.get((i, 1), 0) for i, t, x in rows if x == s and t]
        assert max(own) - min(own) <= 1
    kept = mixing.mix(table, max_repeat=1.5).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _, _ in rows}
    most = Counter()
    for r in kept:
        most[r["source"]] += r["n_tokens"] / total[r["source"]]
    assert max(most.values()) < 1.5 * 1.1 * min(most.values())
    assert mixing.mix(no_documents, entropy=0.9).count() == 0
    once = mixing.mixed_documents(documents, entropy=0.1)
    assert once.columns == documents.columns and once.exceptAll(documents).count() == 0 and documents.exceptAll(once).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(table)


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i % 40, f"word {i % 40}", "a" if i % 4 else "b") for i in range(80)]  # every row twice
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = mixing.mix(table, max_repeat=1.0)
    found = mixing.mixed_documents(table, max_repeat=1.0)
    assert found.count() == dealt.count() and found.select("doc_id").distinct().count() == 40
    assert found.join(table.distinct(), ["doc_id", "text", "source"], "left_anti").count() == 0


@pytest.fixture(scope="module")
def path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_ids_equal_those_of_whole_texts(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b \t c", "x  y", "it's he'll 12,3 ¿qué? naïve", "<|endoftext|> x <|endoftext|>", "漢字 か な", "a b c", "Ġ Ġx", "​ a"]
    texts += ["".join(rng.choice(" \n\tab.,'sé漢1Ġ ") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("abcdeéü.,\n1") for _ in range(rng.randrange(1, 9))) for _ in range(50)) for _ in range(50)]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # again with known words
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.token_ids(texts, path)] == want


def test_pieces():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [p[:2] for p in packing.pieces_of(ids, 4)] == [(0, 2), (2, 4), (6, 4)]
    assert [p[:2] for p in packing.pieces_of(ids, 5)] == [(0, 5), (5, 5)]
    assert [p[:2] for p in packing.pieces_of(ids, 10)] == [(0, 10)] == [p[:2] for p in packing.pieces_of(ids, 50)]


def least_bins(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i, b in enumerate(bins):
            if b >= lengths[k] and b not in bins[:i]:
                go(k + 1, [*bins[:i], b - lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, capacity - lengths[k]])

    go(0, [])
    return best[0]


def bound(counts, capacity):
    """Martello and Toth's L2: what items over half the capacity leave for the others."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        half = {n: c for n, c in counts.items() if capacity / 2 < n <= capacity - k}
        rest = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(6)
    for capacity in (10, 12):
        for _ in range(120):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
            plan = packing.pack_counts(Counter(lengths), capacity)
            got = Counter()
            for n, own in plan:
                assert sum(own) <= capacity
                for x in own:
                    got[x] += n
            assert got == Counter(lengths)
            assert sum(n for n, _ in plan) <= least_bins(lengths, capacity) + (1 if len(lengths) > 5 else 0)
    many = Counter({n: rng.randrange(1, 2000) for n in range(1, 1025)})
    plan = packing.pack_counts(many, 1024)
    assert sum(n for n, _ in plan) <= 1.005 * bound(many, 1024) + 2
    assert packing.pack_counts({}, 8) == []
    with pytest.raises(ValueError):
        packing.pack_counts({9: 1}, 8)


def test_packing(documents, odd_documents, no_documents, path):
    found = packing.pack(documents, path, capacity=64).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert by_doc[2000] == [(0, 0, 1)]
    assert len(by_doc[7]) == 2 * len(set(by_doc[7]))  # a repeated row
    want = sum(len(x) // 4 + 1 for x in packing.token_ids([t or "" for _, t in odd_documents], path))
    assert sum(r["length"] for r in found) == want
    assert len(by_sequence) <= -(-want // 64) + 2
    assert packing.pack(no_documents, path).count() == 0


def toxic_rows():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randrange(1, 9)):
                words.insert(rng.randrange(len(words)), "villain" + rng.choice(["", "s", "ous", "y!"]) if rng.random() < 0.5 else "Scum,")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, documents, no_documents):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, grade string, weight double")
    truth = spark.createDataFrame([*labels, (5, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.learn(table.filter("doc_id < 300"), truth)
    assert (np.diff(model.thresholds) > 0).all()
    graded = toxicity.grade(table, model)
    assert set(graded.columns) == {"doc_id", "text", "weight", "severity", "grade", "p_toxic"}
    unseen = graded.filter("doc_id >= 300").join(truth.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    wrong = [r for r in unseen if (r["p_toxic"] >= 0.5) != (r["toxic"] == 1)]
    assert len(unseen) == 100 and not wrong, wrong
    odd = toxicity.grade(documents, model)
    assert odd.count() == documents.count()
    assert {r["severity"] for r in odd.filter("text is null or trim(text) = ''").collect()} == {0.0}
    assert toxicity.grade(no_documents, model).count() == 0
    none = toxicity.learn(no_documents, truth)
    assert toxicity.grade(table, none).filter("p_toxic > 0.01").count() == 0


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4)) < 0.5
    score = x @ np.array([2.0, 1.0, -1.0, 0.0])
    grades = (score[:, None] + rng.logistic(size=(3000, 1)) > np.array([0.0, 1.5, 3.0])).sum(1)
    owner, feature = np.nonzero(x)
    weights, thresholds = toxicity.fit_ordinal(owner, feature, grades, 4, penalty=0.0)
    assert np.allclose(weights, [2, 1, -1, 0], atol=0.35) and (np.diff(thresholds) > 0).all()
    model = toxicity.Grader(np.arange(4, dtype=np.uint64), weights, thresholds)
    p = model.probabilities(np.array([-2.0, 0.0, 4.0]))
    assert np.allclose(p.sum(1), 1) and (np.diff(p @ np.arange(4)) > 0).all()


def test_licences(spark, documents, no_documents):
    rng = random.Random(1)
    prose = lambda: " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(3, 60)))
    rows = [(i, "\n".join(prose() for _ in range(4))) for i in range(150)]
    known = {
        900: ("mit", "Released under the MIT License."),
        901: ("apache-2.0", 'LICENSED under the apache license, version 2.0 (the "License")'),
        902: ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
        903: ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0. All pictures."),
        904: ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    }
    rows += [(i, f"{prose()}\n\n{text}\n{prose()}") for i, (_, text) in known.items()]
    rows += [(950, "Licensed under the Foo Corporation source terms of use, edition nine"), (951, None), (952, ""), (953, rows[-1][1]), (953, rows[-1][1])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, family string, words string")
    found = [r.asDict() for r in licenses.scan(table).collect()]
    sure = {(r["doc_id"], r["paragraph"], r["family"]) for r in found if r["confirmed"]}
    assert sure == {(i, 2, f) for i, (f, _) in known.items()} | {(953, 2, "gpl-2.0")}
    assert sum(r["doc_id"] == 953 for r in found) == 2
    assert all((r["family"] == "unknown") == (not r["confirmed"]) for r in found)
    assert licenses.scan(documents).filter("confirmed").count() == 0
    assert licenses.scan(no_documents).count() == 0


def test_licence_scan_has_no_python(spark):
    table = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    plan = licenses.scan(table)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
