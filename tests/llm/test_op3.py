import random

import numpy as np
import pytest
from primeweft.llm import op3_jaccard as o
from primeweft.llm import textblocks


def sets_of(text, k):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    s = [sets_of(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s[i]), ids.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "percent", "together", "seed"), [(4, 85, 1024, 1), (4, 85, 4, 2), (5, 80, 6, 3), (1, 50, 8, 4)])
def test_against_brute_force(spark, monkeypatch, k, percent, together, seed):
    monkeypatch.setattr(textblocks, "BLOCK", 6000)
    monkeypatch.setattr(o, "TOGETHER", together)
    r = random.Random(seed)
    pool = [f"W{i}" for i in range(400)] + ["é,", "x"]
    rows = []
    for i in range(25):
        base = [r.choice(pool) for _ in range(r.choice([1, 2, 3, 5, 12, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(pool)
            if r.random() < 0.3:
                w += base[: r.randint(0, 8)]
            rows.append((len(rows) * 7 % 1000 + i, " ".join(w).upper() if r.random() < 0.2 else "  ".join(w), "c"))
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):  # a chain of links
        rows.append((2000 - i, " ".join(chain[i : i + 60]), "c"))
    rows += [(3000, None, "c"), (3001, "", "c"), (3002, " \n", "c"), (None, rows[0][1], "c"), (None, "only null", "c"), rows[5], rows[5]]
    rows += [(4000 + i, f"hot passage of some words that many have {i}", "c") for i in range(60)]
    got = o.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(3), k=k, percent=percent).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, k, percent)


def test_empty_table(spark):
    assert o.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def classes(n, links):
    p = list(range(n))
    for a, b in links:
        x, y = p[a], p[b]
        p = [min(x, y) if v in (x, y) else v for v in p]
    return p


def least_of(label):
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(label)]


@pytest.mark.parametrize("matrix", [1 << 25, 1 << 12])
def test_trie_finds_every_component(monkeypatch, matrix):
    monkeypatch.setattr(o, "MATRIX", matrix)
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = np.unique(rng.integers(0, 500, rng.choice([4, 60, 300]))).astype(np.uint64)
        sets = []
        for _ in range(40):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 500, rng.integers(1, 6)).astype(np.uint64)))))
        n = np.array([len(x) for x in sets])
        rank_of = rng.integers(1, 9, 500).astype(np.uint8)
        ranks = [rank_of[x.astype(int)] for x in sets]
        want = {(i, j) for j in range(40) for i in range(j) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (n[i] + n[j])}
        assert classes(40, want) == least_of(o.trie_join(sets, ranks, n, 85).tolist())
        side = rng.integers(0, 2, 40)
        cross = [(i, j) for i, j in want if side[i] != side[j]]
        assert classes(40, cross) == least_of(o.trie_join(sets, ranks, n, 85, side).tolist())


def test_hashes_are_packed_without_loss():
    rng = np.random.default_rng(6)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (textblocks.unpacked(textblocks.packed(h)) == h).all()


def test_ids_of_strings(spark):
    rows = [("b", "one two three four five"), ("a", "one two  three four FIVE"), ("c", "six seven"), (None, "six  seven")]
    got = o.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted([("b", 2, "a"), ("a", 2, "a"), ("c", 1, "c"), (None, 1, "c")], key=str)
