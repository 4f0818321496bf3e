"""Weighted acyclic automata over sequences of labels: counts of phrases, shared where their continuations agree.

An automaton is kept packed while it travels: states of one depth with the same weight and the same arcs are one state. In a
task it is unfolded into a `Trie`, a table of nodes for each depth, on which numpy works level by level.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

Path = tuple[bytes, ...]
_MASK = np.int64(0xFFFFFFFF)


@dataclass(frozen=True)
class Trie:
    """words: the labels in ascending order. parent, label, weight: for each depth, its nodes in ascending order of their
    paths; a node whose path is not in the set has weight 0."""

    words: list[bytes]
    parent: list[np.ndarray]
    label: list[np.ndarray]
    weight: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.parent)

    def nodes(self) -> int:
        return sum(len(p) for p in self.parent)

    @cached_property
    def index(self) -> dict[bytes, int]:
        return _index(self.words)

    @cached_property
    def keys(self) -> list[np.ndarray]:
        return [p.astype(np.int64) << 32 | x for p, x in zip(self.parent, self.label, strict=True)]

    def starts(self, d: int) -> np.ndarray:
        """Where the children of each node of depth d start on the next, and their end."""
        if d + 1 >= self.depth:
            return np.zeros(len(self.parent[d]) + 1, np.int64)
        return np.searchsorted(self.parent[d + 1], np.arange(len(self.parent[d]) + 1))

    def paths(self, d: int, at: np.ndarray) -> np.ndarray:
        """Labels from the root down to the given nodes of depth d, a row for each."""
        out = np.empty((len(at), d + 1), np.int64)
        for k in range(d, -1, -1):
            out[:, k] = self.label[k][at]
            at = self.parent[k][at]
        return out

    def find(self, words: list[bytes], paths: np.ndarray) -> np.ndarray:
        """Nodes of the given paths, whose labels count within `words`; -1 where there is none."""
        to = _places(words, self.index)
        node = np.zeros(len(paths), np.int64)
        for k in range(paths.shape[1]):
            label = to[paths[:, k]] if len(to) else np.full(len(paths), -1)
            keys, want = self.keys[k], node << 32 | np.maximum(label, 0)
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            hit = (keys[at] == want) & (label >= 0) & (node >= 0) if len(keys) else np.zeros(len(paths), bool)
            node = np.where(hit, at, -1)
        return node


def _index(words: list[bytes]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(words)}


def _places(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))


def empty(depth: int) -> Trie:
    none = [np.zeros(0, np.int64) for _ in range(depth)]
    return Trie([], none, none, none)


def counted(words: list[bytes], first: np.ndarray, following: np.ndarray, start: np.ndarray, depth: int) -> Trie:
    """The counts of all sequences of up to `depth` labels: the first label of place i is first[i], the next are
    following[i], following[i + 1] and so on up to a negative one. Only places in `start` count; `following` reaches
    `depth` places further than the last of them."""
    at = start
    label, node, n = np.unique(first[at], return_inverse=True, return_counts=True)
    parents, labels, weights = [np.zeros(len(label), np.int64)], [label.astype(np.int64)], [n]
    for d in range(depth - 1):
        label = following[at + d]
        on = label >= 0
        at = at[on]
        key = node[on].astype(np.int64) << 32 | label[on]
        if d < depth - 2:
            key, node, n = np.unique(key, return_inverse=True, return_counts=True)
        else:
            key, n = np.unique(key, return_counts=True)
        parents.append(key >> 32)
        labels.append(key & _MASK)
        weights.append(n)
    return Trie(words, parents, labels, weights)


def from_paths(words: list[bytes], groups: list[tuple[np.ndarray, np.ndarray]], depth: int) -> Trie:
    """The set of all rows of labels, each with the largest weight that it is given."""
    nodes = [np.zeros(len(rows), np.int64) for rows, _ in groups]
    parents, labels, weights = [], [], []
    for d in range(depth):
        live = [g for g, (rows, _) in enumerate(groups) if rows.shape[1] > d]
        key = np.concatenate([nodes[g] << 32 | groups[g][0][:, d] for g in live]) if live else np.zeros(0, np.int64)
        key, node = np.unique(key, return_inverse=True)
        weight, at = np.zeros(len(key), np.int64), 0
        for g in live:
            rows, w = groups[g]
            nodes[g] = node[at : at + len(rows)].astype(np.int64)
            at += len(rows)
            if rows.shape[1] == d + 1:
                np.maximum.at(weight, nodes[g], w)
        parents.append(key >> 32)
        labels.append(key & _MASK)
        weights.append(weight)
    return Trie(words, parents, labels, weights)


def union(tries: list[Trie], by: Callable = np.add) -> Trie:
    """All paths of several automata; weights of the same path are joined by `by`."""
    if len(tries) == 1:
        return tries[0]
    words = sorted(set().union(*[t.words for t in tries]))
    index = _index(words)  # once for all automata, as there may be many small ones
    to = [_places(t.words, index) for t in tries]
    nodes: list[np.ndarray] = [np.zeros(1, np.int64) for _ in tries]
    parents, labels, weights = [], [], []
    for d in range(max(t.depth for t in tries)):
        key = np.concatenate([n[t.parent[d]] << 32 | m[t.label[d]] if len(t.label[d]) else np.zeros(0, np.int64) for t, m, n in zip(tries, to, nodes, strict=True)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        weight = np.concatenate([t.weight[d] for t in tries])[order]
        node = np.empty(len(key), np.int64)
        node[order] = np.cumsum(new) - 1
        nodes = np.split(node, np.cumsum([len(t.label[d]) for t in tries])[:-1])
        parents.append(key[at] >> 32)
        labels.append(key[at] & _MASK)
        weights.append(by.reduceat(weight, at) if len(at) else weight)
    return Trie(words, parents, labels, weights)


def at_least(trie: Trie, least: int) -> Trie:
    """The paths of at least that weight."""
    parents, labels, weights = [], [], []
    kept = None  # nodes of the next depth that stay
    for d in range(trie.depth - 1, -1, -1):
        keep = trie.weight[d] >= least
        if kept is not None:
            keep[trie.parent[d + 1][kept]] = True
            parents[-1] = (np.cumsum(keep) - 1)[parents[-1]]
        parents.append(trie.parent[d][keep])
        labels.append(trie.label[d][keep])
        weights.append(np.where(trie.weight[d] >= least, trie.weight[d], 0)[keep])
        kept = keep
    return _lean(Trie(trie.words, parents[::-1], labels[::-1], weights[::-1]))


def _lean(trie: Trie) -> Trie:
    """Without labels that no node has."""
    used = np.unique(np.concatenate(trie.label))
    return Trie([trie.words[i] for i in used], trie.parent, [np.searchsorted(used, x) for x in trie.label], trie.weight)


def _before(trie: Trie, cut: Path) -> list[int]:
    """How many nodes of each depth stand before a path in the order of paths, where a path precedes its continuations."""
    out, low, high, exact = [], 0, len(trie.parent[0]), True
    for d in range(trie.depth):
        if d:
            at = np.searchsorted(trie.parent[d], [low, low + 1])
            low, high = int(at[0]), int(at[1]) if exact else int(at[0])
        if exact and d < len(cut):
            rank = bisect_left(trie.words, cut[d])
            there = low + int(np.searchsorted(trie.label[d][low:high], rank))
            exact = there < high and rank < len(trie.words) and trie.words[rank] == cut[d] and trie.label[d][there] == rank
            # A path that goes on below this node stands after the node itself.
            out.append(there + 1 if exact and d + 1 < len(cut) else there)
            low = there
        else:
            exact = False
            out.append(low)
    return out


def split(trie: Trie, cuts: list[Path]) -> list[tuple[int, Trie]]:
    """The automaton's part in each range of paths that has one; range j starts with cuts[j - 1]. Nodes that lead to a part
    without belonging to it have weight 0 there."""
    ends = [_before(trie, c) for c in cuts] + [[len(p) for p in trie.parent]]
    begin, out = [0] * trie.depth, []
    for j, end in enumerate(ends):
        if any(b < e for b, e in zip(begin, end, strict=True)):
            first, stop = list(begin), list(end)
            for d in range(trie.depth - 1, 0, -1):  # the way down to the first node of each depth
                if first[d] < stop[d]:
                    top = int(trie.parent[d][first[d]])
                    first[d - 1] = min(first[d - 1], top) if first[d - 1] < stop[d - 1] else top
                    stop[d - 1] = max(stop[d - 1], int(trie.parent[d][stop[d] - 1]) + 1)
            parents, labels, weights = [], [], []
            for d in range(trie.depth):
                a, z = first[d], stop[d]
                weight = trie.weight[d][a:z].copy()
                weight[: max(0, begin[d] - a)] = 0
                parents.append(trie.parent[d][a:z] - (first[d - 1] if d else 0))
                labels.append(trie.label[d][a:z])
                weights.append(weight)
            out.append((j, _lean(Trie(trie.words, parents, labels, weights))))
        begin = end
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _states(weight: np.ndarray, starts: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first node of each state, the state of each node). Nodes are one state if weight, labels and targets agree: they
    are put together by a hash of these and then compared."""
    n_arcs = np.diff(starts)
    for seed in range(1, 9):
        k = np.random.default_rng(seed).integers(1, 1 << 62, 5, dtype=np.uint64) | np.uint64(1)
        mark = weight.astype(np.uint64) * k[0] + n_arcs.astype(np.uint64) * k[1]
        if len(label):
            arc = (label.astype(np.uint64) + k[2]) * k[3] ^ (target.astype(np.uint64) + k[4]) * k[0]
            arc = (arc ^ arc >> np.uint64(29)) * k[2]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arc ^ arc >> np.uint64(31))])
            mark += (sums[starts[1:]] - sums[starts[:-1]]) * k[3]
        _, first, state = np.unique(mark, return_index=True, return_inverse=True)
        same = first[state]
        ok = np.array_equal(weight[same], weight) and np.array_equal(n_arcs[same], n_arcs)
        if ok and len(label):
            there = np.repeat(starts[same] - starts[:-1], n_arcs) + np.arange(len(label))
            ok = np.array_equal(label[there], label) and np.array_equal(target[there], target)
        if ok:
            return first, state
    return np.arange(len(weight)), np.arange(len(weight))  # every node a state of its own: larger, and right as well


def _rows(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers starts[i], starts[i] + 1, ... of counts[i] each, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def pack(trie: Trie) -> bytes:
    """The automaton's states and arcs, from the deepest up."""
    tables = []
    label = target = np.zeros(0, np.int64)
    state = None
    for d in range(trie.depth - 1, -1, -1):
        starts = trie.starts(d)
        first, state = _states(trie.weight[d], starts, label, target)
        n_arcs = np.diff(starts)[first]
        rows = _rows(starts[first], n_arcs)
        tables.append([_small(x) for x in (trie.weight[d][first], n_arcs, label[rows], target[rows])])
        label, target = trie.label[d], state
    root = [_small(label), _small(target)]
    lengths = _small(np.fromiter(map(len, trie.words), np.int64, len(trie.words)))
    raw = pickle.dumps((b"".join(trie.words), lengths, root, tables[::-1]), protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> Trie:
    joined, lengths, (label, state), tables = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    words = [joined[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    parent = np.zeros(len(label), np.int64)
    parents, labels, weights = [], [], []
    for weight, n_arcs, arc_label, arc_target in tables:
        state = state.astype(np.int64)
        parents.append(parent)
        labels.append(label.astype(np.int64))
        weights.append(weight[state].astype(np.int64) if len(state) else np.zeros(0, np.int64))
        counts = n_arcs[state].astype(np.int64) if len(state) else np.zeros(0, np.int64)
        starts = np.cumsum(n_arcs, dtype=np.int64) - n_arcs
        rows = _rows(starts[state] if len(state) else counts, counts)
        parent = np.repeat(np.arange(len(state)), counts)
        label, state = arc_label[rows], arc_target[rows]
    return Trie(words, parents, labels, weights)
