"""Phrase collocations, by weighted acyclic automata that count all phrases of a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import automata
from .automata import Path, Trie
from .common import arrow_batches, cut

WORDS = 3  # words of the longest phrase
LEAST, PARTS = 10, 50  # occurrences of a candidate; percent of them inside a longer candidate that drop it
RANGE_BYTES, MOST_RANGES = 4 << 20, 65_536  # of text behind a range of phrases; beyond 256 GB of text ranges grow instead
SAMPLE, DRAWN = 4096, 32  # texts that the cuts between ranges are chosen from, and phrases of each; they decide sizes alone
AT_ONCE, BYTES_AT_ONCE = 1 << 20, 1 << 24  # words that a task counts before it writes an automaton, and nodes that are united at a time; bytes of these words

_MARK = b"\xff"  # stands in no UTF-8
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _MARK * 10)
_BLANK = re.compile(rb"[ \t\n]")
_PIECE = 1 << 20  # bytes of a text that are split at a time


def split_words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, with a mark between its pieces, some at a time."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            blank = _BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[at:end].translate(_CLEAN).replace(_MARK, b" \xff ").split()
        at = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Counts the phrases of the texts that a task meets."""

    def __init__(self, words: int):
        self.words, self.held = words, {}
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.streams, self.size, self.bytes = _Numbers({_MARK: 0}), {}, 0, 0

    def add(self, lang: bytes, text: bytes) -> Iterator[Trie]:
        for words in split_words(text):
            ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self.streams.setdefault(lang, []).append(ids)
            self.size += len(ids)
            self.bytes += sum(map(len, words))
            if self.size >= AT_ONCE or self.bytes >= BYTES_AT_ONCE:
                yield self.trie(last=False)
        self.streams.setdefault(lang, []).append(np.zeros(1, np.int32))

    def trie(self, last: bool) -> Trie:
        """The counts so far. Phrases that start with the last words of a language's texts are left to the next time, as they may go on."""
        back = 0 if last else self.words - 1
        langs = sorted(self.streams)
        words = sorted({*self.numbers, *langs} - {_MARK})
        rank = {w: i for i, w in enumerate(words)}
        to = np.fromiter((rank.get(w, -1) for w in self.numbers), np.int64, len(self.numbers))
        to[0] = -1
        known = list(self.numbers)
        ids, first, start, held, at = [], [], [], {}, 0
        for lang in langs:
            stream = np.concatenate(self.streams[lang])
            ids += [to[stream], np.full(self.words, -1)]
            first.append(np.full(len(stream) + self.words, rank[lang]))
            counts = np.flatnonzero(to[stream[: max(0, len(stream) - back)]] >= 0)
            start.append(counts + at)
            at += len(stream) + self.words
            if back:
                held[lang] = [known[i] for i in stream[-back:]]
        trie = automata.empty(self.words + 1)
        if langs:
            trie = automata.counted(words, np.concatenate(first), np.concatenate(ids), np.concatenate(start), self.words + 1)
        self._reset()
        for lang, tail in held.items():
            self.streams[lang] = [np.fromiter(map(self.numbers.__getitem__, tail), np.int32, len(tail))]
        return trie


def _encoded(batch: pd.DataFrame) -> Iterator[tuple[bytes, bytes]]:
    for lang, text in zip(batch["lang"], batch["text"], strict=True):
        yield ("und" if lang is None else lang).encode(), (text or "").encode()


def _cuts(docs: DataFrame, words: int, range_bytes: int) -> list[Path]:
    """Paths that part all phrases into ranges of about equal numbers of different phrases, from a sample of the texts."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = min(MOST_RANGES, size // range_bytes)
    if count < 2:
        return []
    drawn = max(DRAWN, 8 * count // SAMPLE)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in _encoded(batch):
                found = [w for part in split_words(text) for w in part if w != _MARK]
                for i in np.unique(np.linspace(0, len(found), drawn, endpoint=False, dtype=int)) if found else ():
                    out.append([lang[:64], *[w[:64] for w in found[i : i + words]]])
            yield pd.DataFrame({"path": out})

    some = docs.sample(min(1.0, SAMPLE / n), seed=1).mapInPandas(draw, "path array<binary>").distinct()
    paths = sorted(tuple(bytes(w) for w in r["path"]) for r in some.toLocalIterator())
    return sorted({paths[j * len(paths) // count] for j in range(1, count)}) if paths else []


def _sorted(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, "kind")


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of each key one after another, never all of them at once."""
    rows = (row for batch in batches for row in batch.to_dict("records"))
    return groupby(rows, key=itemgetter(key))


_TRAVEL = "range int, block int, kind int, automaton binary"


def count_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, list[Path]]:
    """(range, automaton) rows: for each range of phrases the automaton of those that stand `least` times in the texts of one
    language, with their counts; and the paths at which ranges start. A path is (language, word, ...); a
    language by itself counts its words.

    `docs` has text and lang. Tasks build an automaton from the sorted phrases of their texts every AT_ONCE words and cut it at the
    ranges; the automata of a range are united and their weights summed. A phrase that a task meets ever so often travels once.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    cuts = _cuts(docs, words, range_bytes)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(words)

        def rows(trie: Trie) -> Iterator[pd.DataFrame]:
            for j, part in automata.split(trie, cuts):
                yield pd.DataFrame({"range": [j], "block": [-1], "kind": [0], "automaton": [automata.pack(part)]})

        for batch in batches:
            for lang, text in _encoded(batch):
                for trie in shard.add(lang, text):
                    yield from rows(trie)
        yield from rows(shard.trie(last=True))

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for j, rows in _groups(batches, "range"):
            tries, waiting = [], 0
            for row in rows:
                tries.append(automata.unpack(row["automaton"]))
                waiting += tries[-1].nodes()
                if waiting > max(AT_ONCE, tries[0].nodes()):
                    tries, waiting = [automata.union(tries)], 0
            found = automata.at_least(automata.union(tries), least)
            yield pd.DataFrame({"range": [j], "automaton": [automata.pack(found)]})

    counted = _sorted(docs.mapInPandas(shards, _TRAVEL), "range").mapInPandas(unite, "range int, automaton binary")
    return cut(counted), cuts


def _parts(trie: Trie) -> Trie:
    """Everything that the scores of the automaton's phrases need: their languages, and all their parts. Parts of two words
    or more weigh as much as the most frequent of the phrases that hold them."""
    groups = []
    for d in range(2, trie.depth):
        at = np.flatnonzero(trie.weight[d])
        paths, a = trie.paths(d, at), trie.weight[d][at]
        groups.append((paths[:, :1], np.ones(len(at), np.int64)))
        for k in range(1, d):
            for i in range(1, d - k + 2):
                groups.append((paths[:, [0, *range(i, i + k)]], a if k > 1 else np.ones(len(at), np.int64)))
    return automata.from_paths(trie.words, groups, trie.depth - 1) if groups else automata.empty(trie.depth)


def _score(trie: Trie, parts: Trie) -> Iterator[pd.DataFrame]:
    """Scores of the automaton's phrases by the weights of their parts, in whole numbers of any size."""
    for d in range(2, trie.depth):
        at = np.flatnonzero(trie.weight[d])
        if not len(at):
            continue
        paths, a = trie.paths(d, at), trie.weight[d][at].astype(object)

        def weight(columns: list[int], paths: np.ndarray = paths) -> np.ndarray:
            return parts.weight[len(columns) - 1][parts.find(trie.words, paths[:, columns])].astype(object)

        best = left = right = None
        for k in range(1, d):
            l, r = weight([0, *range(1, k + 1)]), weight([0, *range(k + 1, d + 1)])  # noqa: E741
            s = 1_000_000 * a * a // (l * r)
            if best is None:
                best, left, right = s, l, r
            else:
                less = s < best
                best, left, right = np.where(less, s, best), np.where(less, l, left), np.where(less, r, right)
        names = [w.decode(errors="replace") for w in trie.words]
        yield pd.DataFrame(
            {
                "lang": [names[i] for i in paths[:, 0]],
                "phrase": [" ".join(names[i] for i in row) for row in paths[:, 1:].tolist()],
                "a": a.astype(np.int64),
                "l": left.astype(np.int64),
                "r": right.astype(np.int64),
                "n": weight([0]).astype(np.int64),
                "score": best.astype(np.int64),
            }
        )


def score_phrases(counted: DataFrame, cuts: list[Path], percent: int = PARTS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all counted phrases of two words and more that no longer one holds `percent` of the time.

    Each range asks the others for the parts of its phrases: an acceptor of these parts, cut at the ranges, is composed with
    the automaton of each range, which answers with their weights. The acceptor's own weights tell a range which of its phrases
    longer ones hold. A part that very many phrases of a range share is asked for once.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in _groups(batches, "range"):
            for row in rows:
                for j, part in automata.split(_parts(automata.unpack(row["automaton"])), cuts):
                    yield pd.DataFrame({"range": [j], "block": [block], "kind": [1], "automaton": [automata.pack(part)]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for j, rows in _groups(batches, "range"):
            own, held = automata.empty(2), []
            for row in rows:
                trie = automata.unpack(row["automaton"])
                if row["kind"] == 0:
                    own, held = trie, [np.zeros(len(w), np.int64) for w in trie.weight]
                    continue
                weights = []
                for d in range(trie.depth):
                    at = own.find(trie.words, trie.paths(d, np.arange(len(trie.label[d])))) if d < own.depth else np.full(len(trie.label[d]), -1)
                    found = at >= 0
                    weight = np.zeros(len(at), np.int64)
                    asked = trie.weight[d] > 0
                    weight[found & asked] = own.weight[d][at[found & asked]]
                    weights.append(weight)
                    if d >= 2:
                        np.maximum.at(held[d], at[found], trie.weight[d][found])
                told = Trie(trie.words, trie.parent, trie.label, weights)
                yield pd.DataFrame({"range": [j], "block": [row["block"]], "kind": [1], "automaton": [automata.pack(told)]})
            free = [np.where(100 * h >= percent * w, 0, w) if d >= 2 else w for d, (h, w) in enumerate(zip(held, own.weight, strict=True))]
            kept = Trie(own.words, own.parent, own.label, free)
            yield pd.DataFrame({"range": [j], "block": [j], "kind": [0], "automaton": [automata.pack(kept)]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _groups(batches, "block"):
            own, told = None, []
            for row in rows:
                if row["kind"] == 0:
                    own = automata.unpack(row["automaton"])
                else:
                    told.append(automata.unpack(row["automaton"]))
            if own is not None and told:
                yield from _score(own, automata.union(told))

    own = counted.select("range", F.lit(-1).alias("block"), F.lit(0).alias("kind"), "automaton")
    asked = counted.mapInPandas(ask, _TRAVEL)
    told = _sorted(own.unionByName(asked), "range").mapInPandas(answer, _TRAVEL)
    return _sorted(told, "block").mapInPandas(score, "lang string, phrase string, a long, l long, r long, n long, score long")


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, percent: int = PARTS, top: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The phrases of 2 to `words` words of each language that stand together most exclusively, ranked.

    Needs text and lang; other columns are not looked at. A null text is empty, a null lang `und`. Empty texts and tables give no phrases;
    rows that repeat count each. Ties of score go to the more frequent, then to the lesser phrase by bytes.
    A phrase may not reach from one text, or piece of a text, into another. Texts of any length are read whole, in pieces.
    """
    counted, cuts = count_phrases(docs, words, least, range_bytes)
    scored = score_phrases(counted, cuts, percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
