"""Collocations, hard negatives and packing against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mavuno.llm import automata, hard_negatives, packing, phrases
from mavuno.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, rank string, a long"


def plain_phrases(rows, least, percent, words=3, top=None):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, words + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        for p, a in candidates.items():
            if 100 * inside[p] >= percent * a:
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def some_text(rng, n):
    words = ["the", "The", "a", "New", "york", "café", "ﬁn", "\x01x", "\x0bq", "0", "of.", "by,", "\n", "ZZ!", "\t", "  "]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("range_bytes", [1 << 23, 3000])
def test_collocations_are_those_of_a_plain_count(spark, range_bytes):
    rng = random.Random(5)
    rows = [(i, some_text(rng, rng.randrange(300)), rng.choice(["en", "sw", None, "und"]), "s", "clash", i) for i in range(120)]
    rows += [(1000 + i, "hot pair " * 400, "en", "s", "clash", i) for i in range(40)]
    rows += [(2000, None, "en", None, None, None), (2001, "", None, None, None, None), (2002, "one " * 30_000, "xx", None, None, None), (2002, "one " * 30_000, "xx", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=10, range_bytes=range_bytes).collect())
    want = plain_phrases([(r[1], r[2]) for r in rows], 10, 50)
    assert len(want) > 300
    assert got == want
    top = phrases.collocations(df, least=3, percent=90, top=7, range_bytes=range_bytes)
    assert sorted(tuple(r) for r in top.collect()) == plain_phrases([(r[1], r[2]) for r in rows], 3, 90, top=7)


def test_longer_phrases_and_empty_tables(spark):
    rows = [("a b c d e. " * 20 + "b c d x. " * 15 + "b c y z", "en")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(df, words=4, range_bytes=50).collect()) == plain_phrases(rows, 10, 50, words=4)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_a_shard_that_writes_often_counts_the_same(monkeypatch):
    rng = random.Random(2)
    texts = [some_text(rng, 2000).encode() for _ in range(6)]
    whole = phrases.Shard(3)
    monkeypatch.setattr(phrases, "AT_ONCE", 10**9)
    assert not [t for x in texts for t in whole.add(b"en", x)]
    want = whole.trie(last=True)
    monkeypatch.setattr(phrases, "AT_ONCE", 700)
    monkeypatch.setattr(phrases, "_PIECE", 1000)
    parts = phrases.Shard(3)
    tries = [t for x in texts for t in parts.add(b"en", x)]
    got = automata.union([*tries, parts.trie(last=True)])
    assert len(tries) > 5 and listed(got) == listed(want)


def listed(trie):
    out = {}
    for d in range(trie.depth):
        at = np.flatnonzero(trie.weight[d])
        for row, w in zip(trie.paths(d, at).tolist(), trie.weight[d][at].tolist(), strict=True):
            out[tuple(trie.words[i] for i in row)] = w
    return out


def test_automata_keep_their_paths():
    rng = random.Random(1)
    sets = [{tuple(rng.choice([b"a", b"b", b"cc", b"d"]) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 4) for _ in range(80)} for _ in range(3)]

    def made(paths):
        words = sorted({w for p in paths for w in p})
        groups = []
        for n in range(1, 5):
            rows = [p for p in paths if len(p) == n]
            groups.append((np.array([[words.index(w) for w in p] for p in rows], np.int64).reshape(len(rows), n), np.array([paths[p] for p in rows], np.int64)))
        return automata.from_paths(words, groups, 4)

    tries = [made(s) for s in sets]
    assert [listed(t) for t in tries] == sets
    assert [listed(automata.unpack(automata.pack(t))) for t in tries] == sets
    both = Counter()
    for s in sets:
        both.update(s)
    joined = automata.union(tries)
    assert listed(joined) == dict(both)
    assert listed(automata.at_least(joined, 4)) == {p: n for p, n in both.items() if n >= 4}
    cuts = sorted({(b"a", b"b"), (b"b",), (b"b", b"x", b"y"), (b"cc", b"a", b"a", b"a"), (b"e",)})
    parts = automata.split(joined, cuts)
    for j, part in parts:
        for p in listed(part):
            assert sum(c <= p for c in cuts) == j
    assert {p: n for _, part in parts for p, n in listed(part).items()} == dict(both)
    # what continues alike is one state: 30 first words share one chain of states
    wide = {(b"%02d" % i, b"x", b"y"): 1 for i in range(30)}
    assert listed(automata.unpack(automata.pack(made(wide)))) == wide
    first, _ = automata._states(np.ones(30, np.int64), np.arange(31), np.zeros(30, np.int64), np.zeros(30, np.int64))
    assert len(first) == 1


def plain_negatives(rows, n_pos=5, n_neg=10):
    out = []
    ok = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, y, v in ok:
        if i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for j, z, w in ok)
        positives = [(-s, j) for s, j, z in scored if z == y and j != i][:n_pos]
        for p, j in positives:
            fit = [(-s, k) for s, k, z in scored if z != y and 30 * p <= -100 * s <= 90 * p][:n_neg]
            out += [(i, j, n, k, p, s) for n, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_are_those_of_a_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.gauss(0.3, 1) for _ in range(11)]) for i in range(0, 900, 3)]
    rows += [(1000 + i, 1, [0.5] * 11) for i in range(60)]  # ties
    rows += [(1100, 2, [0.0] * 11), (1200, 1, [1e6] * 11), (1300, 9, [1.0] * 11), (1400, 0, [1.0, 2.0]), (1401, 1, [1.0] * 30)]
    rows += [(1500, None, [1.0]), (1600, 1, None), (1700, 1, [float("nan")]), (1800, 1, [None, 1.0]), (1900, 1, [float("inf")]), (None, 1, [1.0]), (2000, 1, [])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, cell string, kind int").repartition(5)
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    want = plain_negatives(rows)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got.collect()) == want
    twice = hard_negatives.hard_negatives(df.filter("vec_id in (300, 303, 306, 309, 312)").unionByName(df.filter("vec_id = 300")), F.col("vec_id") % 100 == 0)
    once = [r for r in rows if r[0] in (300, 303, 306, 309, 312)]
    assert sorted(tuple(r) for r in twice.collect()) == sorted(2 * plain_negatives(once))
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 1000, 2**40, 2**70])
def test_scores_of_any_size_are_exact(scale):
    rng = random.Random(scale)
    anchors, rows = ([[rng.randrange(-scale, scale + 1) for _ in range(n)] for _ in range(m)] for n, m in ((13, 5), (20, 9)))
    kind = np.int64 if scale < 2**60 else object
    got = hard_negatives.Scorer(np.array(anchors, kind)).scores(hard_negatives.bit_planes(np.array(rows, kind)))
    limit = (1 << 63) - 1
    assert got.tolist() == [[max(-limit, min(limit, sum(p * q for p, q in zip(a, r)))) for a in anchors] for r in rows]


def check_packing(rows, pieces, window=2048):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    known.encode_special_tokens = True
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(doc_id, ids.tobytes())] += 1
    spans = defaultdict(list)
    for r in pieces:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        spans[(r["doc_id"], r["doc_tokens"])].append(r)
    got = Counter()
    for (doc_id, n), parts in spans.items():
        by_start = defaultdict(list)
        for r in parts:
            by_start[r["start"]].append(r)
        while any(by_start.values()):  # documents of one id and length are told apart by their ids
            at, ids = 0, b""
            while at < n:
                r = by_start[at].pop()
                ids += bytes(r["ids"])
                at += r["length"]
            got[(doc_id, ids)] += 1
    assert got == want
    filled = defaultdict(list)
    for r in pieces:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    short = 0
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
        short += at < window
    return short


def test_packing_holds_every_id_once_and_every_share(spark):
    rng = random.Random(4)
    rows = [(i, some_text(rng, rng.randrange(900)), "en", rng.choice(["hot", "hot", "b", "c", None]), "x", 1) for i in range(400)]
    rows += [(500, None, "en", "rare", "x", 1), (501, "", "en", "rare", "x", 1), (None, "no id <|endoftext|>", "en", "b", "x", 1), (502, "long text " * 30_000, "en", "c", "x", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    pieces = packing.pack(df, VOCABULARY, lane=40_000).collect()
    short = check_packing(rows, pieces)
    total = sum(r["length"] for r in pieces)
    assert short <= 11 * (total // 40_000 + 1)
    share, taken = Counter(), defaultdict(Counter)
    for r in pieces:
        share[r["source"]] += r["length"]
        taken[r["sequence_id"]][r["source"]] += r["length"]
    for counts in taken.values():
        if sum(counts.values()) == 2048:
            assert all(abs(counts[s] - 2048 * n / total) < 2 * packing.PACKET for s, n in share.items())
    joined = packing.sequences(packing.pack(df, VOCABULARY, lane=40_000)).collect()
    assert all(r["length"] * 4 == len(r["ids"]) for r in joined) and sum(r["length"] for r in joined) == total
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_packing_to_stated_weights(spark):
    rng = random.Random(6)
    rows = [(i, some_text(rng, 400), "en", "abcd"[i % 4], "x", 1) for i in range(300)] + [(7, "same id twice", "en", "a", "x", 1)] * 2
    df = spark.createDataFrame(rows, DOCS)
    pieces = packing.pack(df, VOCABULARY, weights={"a": 0.6, "b": 0.3, "c": 0.1}, lane=20_000, most_queues=3).collect()
    check_packing(rows, pieces)
    first = Counter()
    for r in pieces:
        if r["sequence_id"] < 20:
            first[r["source"]] += r["length"]
    total = sum(first.values())
    assert first["d"] == 0 and abs(first["a"] / total - 0.6) < 0.02 and abs(first["b"] / total - 0.3) < 0.02
    ends = packing.phases([100_000, 50_000, 0, 70_000], [0.5, 0.5, 0.1, 0.0])
    assert ends.tolist() == [[50_000, 50_000, 0, 0], [100_000, 50_000, 0, 0], [100_000, 50_000, 0, 70_000]]


def test_lanes_part_every_queue():
    lanes = packing.Lanes(packing.phases([1_000_003, 17, 5_000, 0], None), 10_000, 64)
    for q, total in enumerate([1_000_003, 17, 5_000, 0]):
        at, where = 0, []
        for j, a, z in lanes.of(q, 0, total):
            starts, sizes = lanes.shares(j)
            assert a == at == starts[q] and z - a == sizes[q]
            at = z
            where.append(j)
        assert at == total and where == sorted(where)
    assert int(lanes.lanes.sum()) <= 64


def test_edge_values_of_ids_and_vectors(spark):
    from mavuno.llm import ann, fingerprints

    least = -(1 << 63)
    docs = spark.createDataFrame([(least, "one two three"), (5, "four five"), ((1 << 63) - 1, "six")] + [(i, f"text {i}") for i in range(100, 160)], "doc_id long, text string")
    assert fingerprints.chained(docs).count() == 63
    rows = [(0, [1e-170, 2e-170]), (1, [1e-170, 2.0000001e-170]), (2, [3.0, 1.0]), (3, [1e300, 1e300]), (50, [5e-324, 0.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(scores) == 8 and abs(scores[0, 1] - 1) < 1e-9 and abs(scores[0, 3] - 3 / math.sqrt(10)) < 1e-12 and scores[50, 3] == pytest.approx(math.sqrt(0.5))
