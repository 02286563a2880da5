import hashlib
import math

import numpy as np
import pytest

from tagloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, id int, v int, part int"


def by_hand(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, one by one."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = [len(r[1]) for r in kept]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    kept = [r for r in kept if len(r[1]) == d]
    width = -(-d // parts)
    cut = {}
    for k, (_, v, _) in enumerate(kept):
        whole = [math.floor(256 * x) for x in v] + [0] * (width * parts - d)
        cut[k] = [whole[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            taken = {}
            for k in cut:
                taken.setdefault(nearest(cut[k][p], books[p])[1], []).append(cut[k][p])
            moved.append([[sum(c) // len(taken[i]) for c in zip(*taken[i])] if i in taken else e for i, e in enumerate(books[p])])
        books = moved
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, sums = [], {}
    for k, (i, _, label) in enumerate(kept):
        found = [nearest(cut[k][p], books[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    return sorted([(i, c, e, sums[x], sha) for i, c, e, x in out], key=str)


def rows_of(n, d, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, spread, d).round(3).tolist(), int(rng.integers(5)) if i % 7 else None) for i in range(n)]


def found(frame):
    return sorted([tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("n,d", [(300, 32), (90, 16), (30, 32), (1, 16), (150, 20)])
def test_codes(spark, n, d):
    rows = rows_of(n, d)
    assert found(codes.compress(frame(spark, rows))) == by_hand(rows)


def test_odd_vectors(spark):
    rows = rows_of(200, 16)
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [0.0] * 15, 1), (-1, [float("inf")] * 16, None)]
    rows += [(2000, [1.0] * 8, 2), (None, [0.1] * 16, 3), (-5, [0.0] * 16, None), (-5, [-0.5] * 16, None)]
    rows += [rows[3]] * 40 + [(3000 + i, rows[5][1], 9) for i in range(60)] + [(4000, [2.0**15] * 16, 4)]
    got = found(codes.compress(frame(spark, rows)))
    assert got == by_hand(rows) and len(got) == 200 + 3 + 40 + 60 + 1


def test_large_labels_and_other_settings(spark, monkeypatch):
    rows = rows_of(120, 8)
    monkeypatch.setattr(codes, "LABELS", 1)
    assert found(codes.compress(frame(spark, rows), parts=4, entries=10, rounds=3)) == by_hand(rows, 4, 10, 3)
    with pytest.raises(ValueError):
        codes.compress(frame(spark, rows), entries=257)


def test_no_usable_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(empty).count() == 0
    assert codes.compress(frame(spark, [(1, None, 1), (2, [float("nan")] * 4, None)])).count() == 0


@pytest.mark.parametrize("leaves", [1, 3, 64, 1 << 11])
def test_trie_at_every_size_of_step(monkeypatch, leaves):
    monkeypatch.setattr(codes, "LEAVES", leaves)
    rng = np.random.default_rng(4)
    for width, high in [(1, 5), (3, 3), (4, 40), (2, 1)]:
        parts, entries = rng.integers(-high, high, (500, width)), rng.integers(-high, high, (20, width))
        trie = codes.Trie(parts)
        distances = ((parts[:, None] - entries[None]) ** 2).sum(2)
        best, error = trie.nearest(entries)
        assert (best[trie.leaf] == distances.argmin(1)).all() and (error[trie.leaf] == distances.min(1)).all()
        assert (trie.rows[trie.leaf] == parts).all() and trie.counts.sum() == 500
        assert len(trie.rows) == len(np.unique(parts, axis=0))
