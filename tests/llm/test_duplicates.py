import hashlib
import random
import re

import numpy as np
import pytest

from tagloom.llm import embeddings, fingerprints, groups, jaccard, shared, substrings


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def linked(rows, k, percent):
    """Brute force: (size, links, component) of each row."""
    sets = [shingle_set(t, k) if i is not None else set() for i, t in rows]
    reach = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                reach[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    out = []
    for x, (i, t) in enumerate(rows):
        out.append((i, len(shingle_set(t, k)), links[x], least.get(root(x))))
    return sorted(out, key=str)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_groups(documents, odd_documents, k, percent):
    found = jaccard.jaccard_groups(documents, k, percent).collect()
    assert sorted([tuple(r) for r in found], key=str) == linked(odd_documents, k, percent)


def test_jaccard_blocks(documents, odd_documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)  # families of many blocks
    found = jaccard.jaccard_groups(documents, 3, 90).collect()
    assert sorted([tuple(r) for r in found], key=str) == linked(odd_documents, 3, 90)


def test_band_keys_find_the_same_groups(documents, odd_documents):
    found = fingerprints.near_copies(documents, 5, 80).collect()
    assert sorted([tuple(r) for r in found], key=str) == linked(odd_documents, 5, 80)


def test_fingerprint_query_has_the_near_copies_of_all_rows(spark, documents, odd_documents, no_documents, tmp_path):
    from tagloom.llm import queries

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_fingerprints(spark, str(tmp_path)).collect()
    want = sorted(((i, n, c) for i, _, n, c in linked(odd_documents, 5, 80)), key=str)
    assert sorted([(r["doc_id"], r["n_links"], r["component_id"]) for r in found], key=str) == want
    assert any(n for _, n, _ in want)
    assert fingerprints.linked_fingerprints(no_documents).count() == 0


def test_empty_tables(no_documents, spark):
    assert jaccard.jaccard_groups(no_documents).count() == 0
    assert substrings.remove_repeats(no_documents).count() == 0
    assert fingerprints.edited_fingerprints(no_documents).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sketch_parts_differ_at_most_as_sets_do():
    """The pigeonhole: sets that link share a key."""
    rng = np.random.default_rng(5)
    for size in (5, 12, 40, 333, 2000):
        for percent in (80, 90):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = int(len(a) * (100 - percent) / percent)
            for b in (a[: len(a) - most], np.unique(np.concatenate([a, rng.integers(0, 1 << 63, most, dtype=np.uint64)]))):
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                of, keys, _ = jaccard.sketch_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                equal = len(a) == len(b)
                assert equal or set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_met_keys(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(40), rng.randrange(6)) for _ in range(300)] + [(99, 1)] * 50 + [(100, k) for k in range(500)]
    rows = [(k, m, 10 * k + m) for k, m in rows]
    members = {}
    for k, m, _ in rows:
        members.setdefault(k, set()).add(m)
    want = sorted((k, m, 10 * k + m) for k, own in members.items() if len(own) > 1 for m in own)
    table = spark.createDataFrame(rows, "key long, member long, more long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys go over many batches
    try:
        assert sorted(map(tuple, shared.met_keys(table).collect())) == want
        found = shared.shared_keys(table.select("key", "member")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted((k, min(own), m) for k, own in members.items() for m in own if m != min(own))


def test_met_keys_count_members_up_to_a_bound(monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    monkeypatch.setattr(shared, "MOST_MEMBERS", 6)
    for _ in range(200):
        rows = sorted((rng.randrange(4), rng.randrange(12)) for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(8)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.record_batch([pa.array([(*r, r[1])[c] for r in part], pa.int64()) for c in range(3)], ["key", "member", "more"]) for part in parts]
        found = [tuple(r.values()) for batch in shared._met(iter(batches)) for r in batch.to_pylist()]
        own = {k: {m for key, m in rows if key == k} for k, _ in rows}
        assert found == sorted((k, m, m, min(6, len(own[k]))) for k in own for m in own[k] if len(own[k]) > 1)


def test_candidates_meet_on_their_rarest_keys_and_store_nothing(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("stored")

    monkeypatch.setattr(jaccard, "stored", fail)
    # Key 1 is common to all; 2 to 7 each to two sets. One key can be spared by sets 0 to 5, none by set 6.
    rows = [(1, m, 2 * (m < 6)) for m in range(7)] + [(2 + m // 2, m, 2) for m in range(6)] + [(7, 6, 0), (7, 5, 2), (8, 6, 0)]
    found = jaccard.candidates(spark.createDataFrame(rows, "key long, set long, spare long")).collect()
    assert {tuple(r) for r in found} == {(0, 1), (2, 3), (4, 5), (5, 6)}


def test_components_of_a_long_path_need_no_rounds_if_a_task_holds_it(spark, monkeypatch):
    names = []
    stored = groups.stored
    monkeypatch.setattr(groups, "stored", lambda df, name: names.append(name) or stored(df, name))
    found = groups.components(spark.range(400).selectExpr("id AS a", "id + 1 AS b").coalesce(1)).collect()
    assert sorted(map(tuple, found)) == [(k, 0) for k in range(401)]
    assert len(names) == 2


def test_stars_reach_what_edges_reach():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 400):
        a, b = rng.integers(0, n + 1, (2, n))
        a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
        node, to = groups.stars(a, b)
        hits = np.zeros((n + 1, n + 1), bool)
        hits[a, b] = hits[b, a] = True
        label = jaccard.local_components(hits)
        assert dict(zip(node.tolist(), to.tolist(), strict=True)) == {k: int(x) for k, x in enumerate(label) if x != k}


def test_words_and_shingles_of_blocks():
    import pyarrow as pa

    texts = ["a b  c", None, "", "B\tc\n", "x", " lead and trail ", "é b", "a b  c"]
    codes, starts, ends, first = shared.words(pa.array(texts))
    raw = "".join(t or "" for t in texts).encode()
    got = [[raw[a:b] for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first, first[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert (codes[:3] == codes[-3:]).all() and len(set(codes.tolist())) == 9
    folded = shared.words(pa.array(["B c"]), fold=True)[0]
    assert (folded == shared.words(pa.array(["b c"]))[0]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(5, 5), (None, 3)] + [(k, k + 1) for k in range(400, 460)]
    found = groups.components(spark.createDataFrame(edges, "a long, b long")).collect()
    reach = {}

    def root(x):
        while reach.setdefault(x, x) != x:
            x = reach[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            reach[y] = x
    assert {tuple(r) for r in found} == {(x, root(x)) for x in reach}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_removal(documents, odd_documents):
    first = {}
    for i, t in odd_documents:
        words = (t or "").encode().split()
        for k in range(len(words) - 12):
            if i is not None:
                key = tuple(words[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t in odd_documents:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(words), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    found = [tuple(r) for r in substrings.remove_repeats(documents).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_hot_anchors_and_small_shards(documents, odd_documents, monkeypatch):
    usual = substrings.remove_repeats(documents).select("doc_id", "n_removed").collect()
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    monkeypatch.setattr(substrings, "SIEVE_BITS", 7)  # all anchors and documents pass
    monkeypatch.setattr(shared, "SIEVE_PART", 6)
    monkeypatch.setattr(substrings, "KEPT_BODIES", 3)
    split = substrings.remove_repeats(documents).select("doc_id", "n_removed").collect()
    assert sorted(usual, key=str) == sorted(split, key=str)


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(2)
    bodies = [rng.integers(0, 4, n) for n in (30, 13, 5, 0, 60)]
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    symbols = np.concatenate(bodies)
    index = substrings.FMIndex(symbols, begins, 8)
    texts = [b.tolist() for b in bodies]
    for at in range(len(index.text) - 6):
        want = index.text[at : at + 6].tolist()
        if 0 in want:
            continue
        length, low, high = index.matches(np.array([at]), 6)
        times = sum(t[k : k + 6] == [w - 1 for w in want] for t in texts for k in range(len(t) - 5))
        assert length[0] == 6 and high[0] - low[0] == times


def test_edited_fingerprints(documents, odd_documents):
    rows = sorted(odd_documents, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = fingerprints.edited_fingerprints(documents, ranges=4).collect()
    by_print = {}
    want = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest()))
        by_print[t] = fingerprints.written(fingerprints.fingerprints([t]))[0]
    assert sorted([tuple(r)[:3] for r in found], key=str) == sorted(want, key=str)
    texts = {(i, len(t or "")): t or "" for i, t in rows}
    for r in found:
        assert r["fingerprint"] == by_print[texts[r["doc_id"], r["n_chars"]]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    one = documents.filter("doc_id = 3").limit(1)
    assert fingerprints.edited_fingerprints(one).first()["near_next"] == 1.0


def test_fingerprints_estimate_similarity():
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    for change in (0, 60, 300):
        other = [w if rng.random() > change / 3000 else "z" + w for w in words]
        a, b = shingle_set(" ".join(words), 5), shingle_set(" ".join(other), 5)
        x, y = fingerprints.fingerprints([" ".join(words), " ".join(other)])
        assert abs((x == y).mean() - len(a & b) / len(a | b)) < 0.15
    assert (fingerprints.fingerprints(["a b c d e f"])[0] == fingerprints.fingerprints(["a  b c d\ne f"])[0]).all()


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = [b / np.linalg.norm(b) + rng.normal(size=16) * s for b in base[:12] for s in (0.0, 0.01, 0.05, 0.08, 0.1) for _ in range(4)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near])]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]])]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] + [0.0] * 14), (1004, [float("inf")] + [0.0] * 15), (1005, [1.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, v string, id long, n_links long")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = x @ x.T >= 0.9
    np.fill_diagonal(hits, False)
    found = {r["vec_id"]: r for r in embeddings.near_vectors(table, pivots=32).collect()}
    assert len(found) == len(rows) + len(odd)
    links = [found[i]["n_links"] for i, _ in rows]
    assert sum(links) >= 0.9 * hits.sum() and all(a <= b for a, b in zip(links, hits.sum(1)))
    label = jaccard.local_components(hits)
    same = np.mean([found[i]["component_id"] == rows[label[k]][0] for k, (i, _) in enumerate(rows)])
    assert same > 0.95
    for i, _ in odd:
        assert found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_rows_of_one_id_are_all_returned(spark):
    """One id with a usable and an unusable vector, and twice the same: a row for each row."""
    rows = [(1, [1.0, 0.0]), (1, None), (1, [0.0, 0.0]), (2, [1.0, 0.001]), (2, [1.0, 0.001]), (None, [1.0, 0.0]), (None, None), (3, [float("nan"), 1.0])]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=2).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    want = [(1, 2, 1, True), (1, 0, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True)]
    assert got == sorted(want, key=str)


def test_large_vector_lists_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.array([1.0, 1, 1, 1]) + rng.normal(size=4) * 0.02]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usual = sorted(map(tuple, embeddings.near_vectors(table, pivots=6).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    assert usual == sorted(map(tuple, embeddings.near_vectors(table, pivots=6).collect()))
    assert all(r[1] == 59 and r[2] == 0 for r in usual)
