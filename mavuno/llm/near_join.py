"""Similarity self-join of documents on word n-grams: MinHash bands, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, joined
from .components import connected

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 24, 4  # a pair at LEAST shares no band with probability (1 - 0.8^4)^24 < 4e-6
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-4  # a pair goes when the posterior probability of reaching LEAST is below this
CHUNK, BYTES = 1024, 8 << 20  # rows, and bytes of shingles, of a group that one task holds against as many others

_A, _B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_A_BACK = np.uint64(pow(int(_A), -1, 1 << 64))
_ODD = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = np.random.default_rng(18).integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_WORD = np.zeros(256, bool)  # bytes of words: ASCII letters and digits, and whatever lies beyond ASCII
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums modulo 2^64, and the factors that move a piece's sum back to place 0."""
    if len(_powers[0]) <= len(raw):
        n = 2 * len(raw) + 1024
        for i, base in enumerate((_A, _A_BACK)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _powers[0][: len(raw)], out=sums[1:])
    return sums, _powers[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words of the lower-cased text; one run of all words if there
    are fewer, none if there are no words."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[raw], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    sums, back = _prefix(raw.astype(np.uint64))
    h = _mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _B + h[j : j + len(out)]
    return np.unique(_mixed(out))


def _keys(x: np.ndarray, text: str) -> tuple[int, int]:
    """128 bits that name a set of shingles, or the text itself if it has no words."""
    if not len(x):
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        x = _prefix(raw)[0][-1:] + np.uint64(len(raw))
    with np.errstate(over="ignore"):
        return tuple(int(v.astype(np.int64)) for v in (_mixed(x * _A + _B).sum(dtype=np.uint64), _mixed(x * _B + _A).sum(dtype=np.uint64)))


def minhashes(x: np.ndarray) -> np.ndarray:
    """The MinHash values of a non-empty set, 32 bits each."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for i in range(0, len(x), 1024):
        least = np.minimum(least, ((x[None, i : i + 1024] ^ _FLIP[:, None]) * _ODD[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def needed(least: float = LEAST, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For h compared values, the least number of equal ones that keeps a pair: with a uniform prior the posterior of the
    likeness is Beta(m + 1, h - m + 1), which reaches `least` with the probability that at most m of h + 1 trials of
    probability `least` succeed."""
    out = {}
    for h in range(STEP, BANDS * ROWS + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(h + 1, m) * least**m * (1 - least) ** (h + 1 - m)
        out[h] = m
    return out


def survivors(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places of the pairs that no step of the comparison has dropped."""
    alive, equal = np.arange(len(i)), np.zeros(len(i), np.int32)
    for h, m in least.items():
        equal = equal + (signatures[i[alive], h - STEP : h] == signatures[j[alive], h - STEP : h]).sum(axis=1, dtype=np.int32)
        keep = equal >= m
        alive, equal = alive[keep], equal[keep]
    return alive


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row of its component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, re-cut so that no group of equal keys is split. Groups are bounded by their callers."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = np.ones(len(rest), bool)
        for k in keys:
            last &= (rest[k] == rest[k].iloc[-1]).to_numpy()
        if not last.all():
            yield rest[~last]
            rest = rest[last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _pairs(sizes: np.ndarray, at_once: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within consecutive groups of these sizes, some hundred thousand at a time."""
    starts = np.cumsum(sizes) - sizes
    for s in np.unique(sizes[sizes > 1]):
        begin = starts[sizes == s]
        a, b = np.triu_indices(s, 1)
        step = max(1, at_once // len(a))
        for x in range(0, len(begin), step):
            yield (begin[x : x + step, None] + a).ravel(), (begin[x : x + step, None] + b).ravel()


def _sides(chunk: np.ndarray, first: np.ndarray, at_once: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs between the rows of one chunk and those of another."""
    left, right = np.flatnonzero(chunk == first), np.flatnonzero(chunk != first)
    step = max(1, at_once // max(1, len(right)))
    for x in range(0, len(left) if len(right) else 0, step):
        part = left[x : x + step]
        yield np.repeat(part, len(right)), np.tile(right, len(part))


def _bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Starts of the groups of sorted rows."""
    change = np.zeros(len(frame), bool)
    change[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _dealt(df: DataFrame, key: str, chunks: Column, node: str) -> DataFrame:
    """Deal each group into as many chunks as `chunks` says, and each row to every pair of chunks that holds its own, so that
    a task compares one chunk with one other whatever the size of a group. Adds chunk, ci and cj, ci <= cj."""
    mine = F.pmod(F.xxhash64(node), F.col("_chunks")).cast("int")
    df = df.withColumn("_chunks", F.ceil(chunks).cast("int")).withColumn("chunk", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    df = df.withColumn("ci", F.least("chunk", "_other")).withColumn("cj", F.greatest("chunk", "_other")).drop("_chunks", "_other")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key, "ci", "cj").sortWithinPartitions(key, "ci", "cj", node)


def _candidate_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    least = needed()
    for frame in _groups(batches, ["bucket", "ci", "cj"]):
        starts = _bounds(frame, ["bucket", "ci", "cj"])
        node, chunk, ci, cj = (frame[c].to_numpy() for c in ("node", "chunk", "ci", "cj"))
        signatures = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(len(frame), -1)
        inner = (ci == cj)[starts]
        sizes = np.diff(np.append(starts, len(frame)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(np.repeat(inner, sizes))
        for i, j in _pairs(sizes[inner]):
            i, j = rows[i], rows[j]
            alive = survivors(signatures, i, j, least)
            found.append((i[alive], j[alive]))
        for at, size in zip(starts[~inner], sizes[~inner], strict=True):
            for i, j in _sides(chunk[at : at + size], ci[at]):
                alive = survivors(signatures, at + i, at + j, least)
                found.append((at + i[alive], at + j[alive]))
        if found:
            label = least_labels(len(frame), np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]))
            tied = label != np.arange(len(frame))
            yield pd.DataFrame({"a": node[label[tied]], "b": node[tied]})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence blocks of the shingles that occur twice or more."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    owner, column = owner[kept], rank[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(256, 4_000_000 // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        out += block @ block.T
    return out


def _verified(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["root", "ci", "cj"]
        for frame in _groups(batches, keys):
            node, size, chunk, ci, cj = (frame[c].to_numpy() for c in ("node", "size", "chunk", "ci", "cj"))
            starts = _bounds(frame, keys)
            links, label = np.zeros(len(frame), np.int64), np.arange(len(frame))
            for at, end in zip(starts, np.append(starts[1:], len(frame)), strict=True):
                sets = [shingles(t) for t in frame["text"].iloc[at:end]]
                n = np.array([len(s) for s in sets], np.float32)
                shared = overlaps(sets)
                near = shared >= np.float32(least - 1e-6) * (n[:, None] + n[None, :] - shared)
                np.fill_diagonal(near, False)
                if ci[at] != cj[at]:
                    near &= chunk[at:end, None] != chunk[None, at:end]
                links[at:end] = near @ size[at:end]
                i, j = np.nonzero(np.triu(near))
                label[at:end] = at + least_labels(end - at, i, j)
            yield pd.DataFrame({"node": node, "links": links, "hook": node[label]})

    return work


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """Groups of documents whose sets of five-word shingles are linked by Jaccard likeness >= `least`.

    Returns a row per row of df: key; copy_id, the least key with an equal set; class_id, the least key of the group
    (components of the links); n_links, the number of other rows at that likeness, equal ones included. Documents
    without words (null and empty ones too) are linked to equal texts only. Rows without a key are returned with
    null ids and no links. Other columns of df are left out.

    1. Equal sets collapse into one node, by a 128-bit key; a node is named by the number of its first row. 2. Nodes that
    agree in a band of MinHash values meet; pairs are compared step by step and dropped when the posterior says so. Only
    spanning edges leave a task, not pairs. 3. Components of these edges hold every pair that is left; in each, all
    pairs of nodes are verified exactly, and counts and spanning edges of the true links leave the task.
    4. Components of the true links are the classes. Groups of more than CHUNK nodes or BYTES bytes are dealt over pairs
    of chunks in 2 and 3, and joins on buckets, components and copies serve hot keys by `joined`.
    """
    arrow_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                x = shingles(t)
                bands, m = np.zeros(0, np.int64), np.zeros(0, np.uint32)
                if len(x):
                    m = minhashes(x)
                    bands = _mixed((m.reshape(BANDS, ROWS).astype(np.uint64) * _ODD[:ROWS]).sum(axis=1, dtype=np.uint64) + _FLIP[:BANDS]).astype(np.int64)
                rows.append((*_keys(x, t), 8 * len(x), m.astype(np.uint16).tobytes(), bands))
            out = pd.DataFrame(rows, columns=["k1", "k2", "bytes", "signature", "bands"])
            yield out.assign(key=batch["key"].to_numpy(), row=batch["row"].to_numpy())

    keyed = docs.filter(F.col("key").isNotNull())
    schema = "k1 long, k2 long, bytes long, signature binary, bands array<long>, key long, row long"
    signed_docs = cut(keyed.withColumn("row", F.monotonically_increasing_id()).mapInPandas(signed, schema))  # rows are numbered once
    nodes = cut(signed_docs.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("key").alias("first"), F.count(F.lit(1)).alias("size"), F.min("bytes").alias("bytes")))
    told = signed_docs.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    told = cut(told.filter(F.size("bands") > 0).select("node", "signature", "bands"))

    rows = told.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    met = joined(rows, shared, ["bucket"], "size", spread=F.col("node")).join(told.select("node", "signature"), "node")
    edges = _dealt(met, "bucket", F.col("size") / CHUNK, "node").mapInPandas(_candidate_edges, "a long, b long")
    loose = connected(edges).join(nodes, "node")

    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("held"))
    wanted = joined(loose.select("node", "root", "first", "size", "k1", "k2"), sizes, ["root"], "members", spread=F.col("node"))
    texts = keyed.join(wanted.withColumnRenamed("first", "key"), "key")

    def proved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # a repeated key may bring another text
        for batch in batches:
            yield batch[[_keys(shingles(t), t) == k for t, k in zip(batch["text"], zip(batch["k1"], batch["k2"], strict=True), strict=True)]]

    if signed_docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        texts = texts.mapInPandas(proved, texts.schema).dropDuplicates(["node"])
    texts = texts.select("root", "members", "held", "node", "size", "text")
    chunks = F.greatest(F.col("members") / CHUNK, F.col("held") / BYTES)
    checked = cut(_dealt(texts, "root", chunks, "node").drop("members", "held").mapInPandas(_verified(least), "node long, links long, hook long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(checked.select(F.col("hook").alias("a"), F.col("node").alias("b")))
    roots = classes.join(nodes, "node").groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    named = joined(classes, roots, ["root"], "_n", spread=F.col("node")).select("node", "class_id")
    about = nodes.join(links, "node", "left").join(named, "node", "left")
    about = about.select("k1", "k2", "first", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "first").alias("class_id"))
    out = joined(signed_docs.select("k1", "k2", "key"), about, ["k1", "k2"], "size", spread=F.col("key"))
    out = out.select(F.col("key").alias(key), F.col("first").alias("copy_id"), "class_id", (F.col("size") - 1 + F.col("links")).alias("n_links"))
    lost = docs.filter(F.col("key").isNull()).select(F.col("key").alias(key), F.lit(None).cast("long").alias("copy_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(lost)
