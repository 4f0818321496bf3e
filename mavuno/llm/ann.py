"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, joined
from .latent import sampled
from .near_join import _bounds

FIT_ROWS = 4096  # bound of the sample that the codes and the radius are fitted on
TABLES = 32  # substrings of a code, each indexed
REACH = 0.98  # share of the sample's true neighbours that the radius must hold, and that probing must meet; more rows only bring them nearer
UNSURE = 8  # bits of a substring that further probes flip
CHUNK = 4096  # rows of a bucket that one task holds
CROWD = 16  # rows within the radius that a query meets in a chunk of a bucket; of more, the nearest are told there by their vectors
QUERIES = 4096  # queries of a block that is compared with all rows


@dataclass(frozen=True)
class Codes:
    """Binary codes of TABLES substrings of `bits` bits each, and the Hamming radius of a search."""

    mean: np.ndarray
    rotation: np.ndarray  # dims x (TABLES * bits)
    bits: int
    further: int  # likeliest values probed for each substring, besides those that differ in one bit at most
    radius: int

    def projected(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.rotation

    def keys(self, projected: np.ndarray) -> np.ndarray:
        """The value of each substring, a row for each vector."""
        return (projected.reshape(len(projected), TABLES, self.bits) > 0) @ (1 << np.arange(self.bits))

    def packed(self, projected: np.ndarray) -> np.ndarray:
        """Whole codes as rows of 64-bit words."""
        raw = np.packbits(projected > 0, axis=1)
        return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)

    def probes(self, projected: np.ndarray) -> np.ndarray:
        """(n, TABLES, probes): the substring values to look up for each query.

        All values that differ from the query's in at most one bit: by the pigeonhole principle every code within
        2 * TABLES - 1 bits is then met. Beyond them the likeliest values: a bit whose projection lies near 0 is the
        likelier to differ, and sets of such bits are taken by the sum of their squares.
        """
        x = projected.reshape(len(projected), TABLES, self.bits)
        own = self.keys(projected)[..., None]
        order, costs, sets = self._unsure(x)
        best = np.argsort(costs, axis=2)[..., : self.further]
        flips = (1 << order) @ sets.T
        return np.concatenate([own, own ^ (1 << np.arange(self.bits)), own ^ np.take_along_axis(flips, best, axis=2)], axis=2)

    def _unsure(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least sure bits of each substring, the cost of each set of two or more of them, and these sets."""
        order = np.argsort(np.abs(x), axis=2)[..., :UNSURE]
        some = order.shape[2]
        sets = np.array([[v >> i & 1 for i in range(some)] for v in range(1 << some) if v.bit_count() > 1], int).reshape(-1, some)
        size = np.take_along_axis(x, order, axis=2) ** 2
        return order, size @ sets.T, sets

    def depth(self, asked: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many further probes of each substring a query (projected) needs until another vector is met; row by row."""
        x, y = (v.reshape(len(v), TABLES, self.bits) for v in (asked, other))
        apart = (x > 0) != (y > 0)
        order, costs, sets = self._unsure(x)
        cost = (apart * x * x).sum(axis=2)
        reachable = np.take_along_axis(apart, order, axis=2).sum(axis=2) == apart.sum(axis=2)
        place = (costs < cost[..., None] * (1 - 1e-12)).sum(axis=2) + 1
        return np.where(apart.sum(axis=2) <= 1, 0, np.where(reachable, place, len(sets))).min(axis=1)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings the largest component to about 1: cosines stay the same to the last bit, and squares of very small
    or large components stay within the range of doubles."""
    most = np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]
    return np.ldexp(np.ldexp(x, -(most // 2)), most // 2 - most)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def fit(sample: np.ndarray, k: int, rows: int, seed: int = 13, rounds: int = 15) -> Codes:
    """Learn the codes for a table of `rows` vectors from a bounded sample: principal axes, rotated so that signs lose least
    (iterative quantization), from as many starts as the bits need; substrings of somewhat fewer bits than log2(rows), as each bit more multiplies the probes; and the
    Hamming radius and the probes that REACH of the k nearest neighbours within the sample need."""
    unit = _units(sample)
    mean = unit.mean(axis=0)
    x = unit - mean
    _, axes = np.linalg.eigh(x.T @ x)
    rng = np.random.default_rng(seed)
    bits = int(np.clip(round(0.75 * np.log2(max(rows, 1)) + 1), 4, 24))
    parts = []
    for _ in range(-(-TABLES * bits // x.shape[1])):
        v = x @ axes
        r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    codes = Codes(mean, np.concatenate(parts, axis=1)[:, : TABLES * bits], bits, 0, 0)
    projected = codes.projected(unit)
    packed = codes.packed(projected)
    asked = np.arange(0, len(unit), max(1, len(unit) // 512))
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -2
    wanted = min(k, 1.5 * k * len(unit) / max(rows, 1))  # half as many again as are expected of the k nearest in the table, to be on the safe side
    near = np.argsort(-cosine, axis=1)[:, : min(int(np.ceil(wanted)), max(1, len(unit) - 1))]
    q, n = np.repeat(asked, near.shape[1]), near.ravel()
    closest = np.argsort(-cosine[np.repeat(np.arange(len(asked)), near.shape[1]), n])[: max(1, round(wanted * len(asked)))]
    q, n = q[closest], n[closest]
    away = hamming(packed[n], packed[q])
    deep = np.concatenate([codes.depth(projected[q[i : i + 256]], projected[n[i : i + 256]]) for i in range(0, len(q), 256)])
    return Codes(mean, codes.rotation, bits, int(np.quantile(deep, REACH)), int(np.quantile(away, REACH)))


def meetings(bucket: np.ndarray, asks: np.ndarray, packed: np.ndarray, radius: int, at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (query, row) within the radius, for rows sorted by bucket, indexed ones before those that ask; a query's are never split."""
    first = np.searchsorted(bucket, bucket, side="left")
    asking = np.flatnonzero(asks)
    counts = np.searchsorted(np.flatnonzero(~asks), asking) - np.searchsorted(np.flatnonzero(~asks), first[asking])
    step = 0
    ends = np.cumsum(counts)
    while step < len(asking):
        upto = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + at_once, side="right")))
        n = counts[step:upto]
        q = np.repeat(asking[step:upto], n)
        row = np.repeat(first[asking[step:upto]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        away = hamming(packed[q], packed[row])
        within = away <= radius
        yield q[within], row[within]
        step = upto


def met(bucket: np.ndarray, asks: np.ndarray, packed: np.ndarray, radius: int, at_once: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """All `meetings` at once."""
    out = [(np.zeros(0, int), np.zeros(0, int)), *meetings(bucket, asks, packed, radius, at_once)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, chunk and ask, re-cut so that all indexed rows of a chunk stand before each of its queries. Queries of
    a chunk that has very many come in several parts, each behind the same indexed rows."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = ((rest["bucket"] == rest["bucket"].iloc[-1]) & (rest["chunk"] == rest["chunk"].iloc[-1])).to_numpy()
        if not last.all():
            yield rest[~last]
            rest = rest[last].reset_index(drop=True)
        if len(rest) > 4 * CHUNK and rest["ask"].iloc[-1]:
            yield rest
            rest = rest[~rest["ask"].to_numpy(bool)].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _codes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `meetings` needs of a frame: numbers of the buckets' chunks, which rows ask, and codes."""
    starts = np.zeros(len(frame), int)
    starts[_bounds(frame, ["bucket", "chunk"])] = 1
    return np.cumsum(starts), frame["ask"].to_numpy(bool), np.frombuffer(b"".join(frame["code"]), np.uint64).reshape(len(frame), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, with the same order of operations for every row."""
    a, b = _scaled(np.atleast_2d(a)), _scaled(np.atleast_2d(b))
    return (b * a).sum(axis=-1) / (_lengths(a) * _lengths(b))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(list(vectors)).astype(np.float64)


def usable(vector: str) -> Column:
    """True for vectors that are not null, not all zero, and of finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def sent(rows: DataFrame, codes: Codes, asks: bool) -> DataFrame:
    """bucket, id, ask, code: each row in the bucket of each of its substrings, or each query in the buckets that it probes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                x = codes.projected(_units(_matrix(part["vector"])))
                keys = codes.probes(x) if asks else codes.keys(x)[..., None]
                buckets = (np.arange(TABLES)[None, :, None] << 32 | keys).reshape(len(part), -1)
                packed = [c.tobytes() for c in codes.packed(x)]
                n = buckets.shape[1]
                yield pd.DataFrame({"bucket": buckets.ravel(), "id": np.repeat(part["id"].to_numpy(), n), "ask": asks, "code": np.repeat(np.array(packed, object), n)})

    return rows.mapInPandas(work, "bucket long, id long, ask boolean, code binary")


def dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows that were `sent`, with the chunk: large buckets are dealt over chunks of about CHUNK rows, and their probes go to each."""
    chunks = F.coalesce(F.ceil(F.col("_size") / CHUNK), F.lit(1)).cast("int")
    rows = joined(rows, large, ["bucket"], "_size", how="left", spread=F.col("id"), keep=False).withColumn("_chunks", chunks)
    mine = F.array(F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(mine)))
    return rows.select("bucket", "chunk", "id", "ask", "code")


def _together(rows: DataFrame) -> DataFrame:
    """The rows of each chunk in one task, indexed ones before those that ask. The keys of the shuffle are (substring, value) and the chunk."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "ask")


def candidates(rows: DataFrame, codes: Codes) -> DataFrame:
    """What the queries meet within the radius, themselves left out: pairs (query_id, id), and for a query that meets more than CROWD
    rows in a chunk of a bucket one row without an id, which names the chunk for `nearest_in_crowds`. So a group of near copies makes
    no row for each pair in it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cells(batches):
            ids = frame["id"].to_numpy()
            for q, row in meetings(*_codes(frame), codes.radius):
                other = ids[q] != ids[row]
                q, row = q[other], row[other]
                crowded = np.bincount(q, minlength=len(frame)) > CROWD
                few = ~crowded[q]
                yield pd.DataFrame({"query_id": ids[q[few]], "id": ids[row[few]]}).drop_duplicates().assign(bucket=None, chunk=None, code=None)
                crowds = frame[crowded]
                yield pd.DataFrame({"query_id": crowds["id"], "id": None, "bucket": crowds["bucket"], "chunk": crowds["chunk"], "code": crowds["code"]})

    return _together(rows).mapInPandas(work, "query_id long, id long, bucket long, chunk int, code binary")


def nearest_in_crowds(index: DataFrame, crowds: DataFrame, base: DataFrame, asking: DataFrame, codes: Codes, k: int) -> DataFrame:
    """The k nearest within the radius that a query meets in each chunk of a bucket where it meets a crowd: query_id, vec_id, score.

    Only these chunks get vectors. What is not among the k nearest of its chunk cannot be among the k nearest of all, so nothing
    is lost; the comparisons inside a chunk are made in numpy, in bounded steps.
    """
    index = index.join(crowds.select("bucket", "chunk").distinct(), ["bucket", "chunk"], "left_semi").join(base, "id")
    asks = crowds.select("bucket", "chunk", F.col("query_id").alias("id"), F.lit(True).alias("ask"), "code").join(asking, "id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cells(batches):
            ids, x = frame["id"].to_numpy(), _scaled(_matrix(frame["vector"]))
            length = _lengths(x)
            for q, row in meetings(*_codes(frame), codes.radius, at_once=max(1, (1 << 19) // x.shape[1])):
                other = ids[q] != ids[row]
                q, row = q[other], row[other]
                score = (x[row] * x[q]).sum(axis=-1) / (length[q] * length[row])
                order = np.lexsort((ids[row], -score, q))
                q, row, score = q[order], row[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pd.DataFrame({"query_id": ids[q[best]], "vec_id": ids[row[best]], "score": score[best]})

    return _together(index.unionByName(asks)).mapInPandas(work, "query_id long, vec_id long, score double")


def scanned(base: DataFrame, asking: list, k: int) -> DataFrame:
    """The k rows of base nearest to each of a bounded block of queries, from each batch of base."""
    ids, x = np.array([r["id"] for r in asking]), np.array([r["vector"] for r in asking], np.float64)
    sent = base.sparkSession.sparkContext.broadcast((ids, x))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, vectors = sent.value
        for batch in batches:
            own, y = batch["id"].to_numpy(), _matrix(batch["vector"])
            for q, v in zip(queries, vectors, strict=True):
                score = np.where(own == q, -np.inf, cosines(v, y))
                best = np.lexsort((own, -score))[:k]
                best = best[own[best] != q]
                yield pd.DataFrame({"query_id": q, "vec_id": own[best], "score": score[best]})

    return base.mapInPandas(work, "query_id long, vec_id long, score double")


def neighbours(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of greatest cosine to each query row, itself excluded: query_id, rank, vec_id, score.

    Every usable row is indexed. Of equal vectors only the k + 1 rows of smallest key can be among the k nearest, so the
    others are left out before the search, which bounds what copies cost and is exact. `candidates` finds what lies
    within the radius; their vectors are joined and reranked in double precision, and where a query meets a crowd of near copies,
    `nearest_in_crowds` ranks them where they lie. Queries with fewer than k candidates
    are compared with all rows, in blocks of QUERIES. Rows without a key take no part; vectors of another length than
    the most frequent one do neither. Ties go to the smaller key; other columns are left out.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    rows = df.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == lengths["n"])
    n = rows.count()
    sample = sampled(rows, FIT_ROWS, F.col("id"), seed=21).select("id", "vector").toPandas().sort_values("id")
    codes = fit(_matrix(sample["vector"]), k, n)

    copies = Window.partitionBy(*[F.xxhash64(F.lit(s), "vector") for s in (0, 1)]).orderBy("id")
    base = cut(rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).select("id", "vector"))
    asking = rows.filter("asks").select("id", "vector")

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"query_id": batch["query_id"], "vec_id": batch["id"], "score": cosines(_matrix(batch["asked"]), _matrix(batch["vector"]))})

    index = sent(base, codes, asks=False)
    large = cut(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > CHUNK))
    near = cut(candidates(dealt(index.unionByName(sent(asking, codes, asks=True)), large), codes))
    pairs = near.filter(F.col("id").isNotNull()).select("query_id", "id").distinct()
    pairs = pairs.join(base, "id").join(asking.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    scored = pairs.mapInPandas(rerank, "query_id long, vec_id long, score double")
    crowds = near.filter(F.col("id").isNull()).select("query_id", "bucket", "chunk", "code")
    if not crowds.isEmpty():
        scored = scored.unionByName(nearest_in_crowds(dealt(index, large), crowds, base, asking, codes, k)).distinct()
    found = cut(ranked(scored))
    full = found.filter(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("id"))
    lacking = cut(asking.join(full, "id", "left_anti"))
    found = found.join(lacking.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    blocks = -(-lacking.count() // QUERIES)
    for i in range(blocks):
        block = lacking.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        if block:
            found = found.unionByName(cut(ranked(scanned(base, block, k))))
    return found.select("query_id", "rank", "vec_id", "score")
