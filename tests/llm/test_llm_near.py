"""The similarity join and its components against brute force."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from mavuno.llm import near_join
from mavuno.llm.components import connected


def naive(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset([("raw", t or "")]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = Counter(), {}
    for i, s in enumerate(sets):
        copies[s] = min(copies.get(s, rows[i][0]), rows[i][0])
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[find(j)] = find(i)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups[find(i)] = min(groups.get(find(i), k), k)
    return sorted((k, copies[sets[i]], groups[find(i)], links[i]) for i, (k, _) in enumerate(rows))


def corpus(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        words = list(rng.choice(vocabulary, rng.integers(20, 300)))
        for _ in range(rng.integers(1, 9)):
            other = list(words)
            for _ in range(rng.integers(0, 9)):
                other[rng.integers(len(other))] = rng.choice(vocabulary)
            rows.append(" ".join(other))
    passage = " ".join(rng.choice(vocabulary, 60))
    rows += [" ".join(rng.choice(vocabulary, 150)) + " " + passage for _ in range(20)]
    rows += ["", None, "  ", "!!", "two words", "Two, words!", "a b c d e", "a b c d f", rows[0], rows[0], rows[0].upper()]
    return [(int(k), t) for k, t in zip(rng.permutation(len(rows)) + 1, rows, strict=True)]


@pytest.mark.parametrize("chunk", [1024, 3])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_join, "CHUNK", chunk)  # so small that groups are dealt over pairs of chunks
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int").repartition(7)
    got = sorted((r["doc_id"], r["copy_id"], r["class_id"], r["n_links"]) for r in near_join.near_duplicates(df).collect())
    assert got == naive(rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert near_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (None, "a b c d e f g"), (2, "H i j, k l m n")]
    got = sorted(((r["doc_id"] or 0), r["copy_id"], r["class_id"], r["n_links"]) for r in near_join.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, None, None, 0), (1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1)]


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near_join.needed()
    assert list(least) == list(range(16, 97, 16)) and sorted(least.values()) == list(least.values())
    rng = np.random.default_rng(2)
    for likeness, most_lost in ((0.8, 0.01), (0.9, 0.0)):
        same = rng.random((4000, 96)) < likeness
        a = rng.integers(0, 60_000, (4000, 96)).astype(np.uint16)
        b = np.where(same, a, a + 1).astype(np.uint16)
        both = np.concatenate([a, b])
        alive = near_join.survivors(both, np.arange(4000), np.arange(4000) + 4000, least)
        assert 1 - len(alive) / 4000 <= most_lost
    far = np.where(rng.random((4000, 96)) < 0.4, a, a + 1).astype(np.uint16)
    assert len(near_join.survivors(np.concatenate([a, far]), np.arange(4000), np.arange(4000) + 4000, least)) < 8


def test_minhash_estimates_likeness():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = x[:3000], x[1000:]
    equal = (near_join.minhashes(a) == near_join.minhashes(b)).mean()
    assert abs(equal - 0.5) < 0.15


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) * (i != j) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = near_join.overlaps(sets)
    np.fill_diagonal(got, 0)
    assert (got == want).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 400)] + [(399, 5), (1, 2), (2, 1), (3, 3)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in (5, 7, *range(200, 400))) and got[2] == got[1] == 1 and 3 not in got
