"""Embedding, exact semantic search and hybrid ranking for many queries, and how well it finds what is expected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .grid import dealt, every, matrix, meet
from .ordered import cut
from .search import rank

# Queries and index rows of a cell; of a cell with very many queries, and how many blocks of queries there are before cells grow; and scores held at a time.
QUERY_BLOCK, INDEX_BLOCK = 2048, 16_384
LARGE_QUERY_BLOCK, LARGE_INDEX_BLOCK, QUERY_BLOCKS, SCORES = 32_768, 131_072, 16, 8_388_608

Encoder = Callable[[list[str]], np.ndarray]


def passage_text(title: Column, body: Column, kind: str = "plain", other: Column | None = None, aliases: Column | None = None) -> Column:
    """The text to embed. Kinds: `plain`, `bilingual` (with the other language's body), `aliases`, `doubled` (the title twice)."""
    dot = F.lit(". ")
    if kind == "bilingual":
        parts = [F.lit("passage: "), title, dot, body, F.lit(". English reference: "), title, dot, other]
    elif kind == "aliases":
        parts = [F.lit("passage: "), title, dot, F.coalesce(F.array_join(aliases, ", "), F.lit("")), dot, body]
    elif kind == "doubled":
        parts = [F.lit("passage: "), title, dot, title, dot, body]
    else:
        parts = [F.lit("passage: "), title, dot, body]
    return T.squash_ws(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def query_text(query: Column) -> Column:
    return F.concat(F.lit("query: "), query)


def code_point_vectors(texts: list[str], dims: int = 384) -> np.ndarray:
    """The fallback encoder: character i adds (code mod 31) / 31 to place i mod dims; unit length."""
    out = np.zeros((len(texts), dims))
    for row, t in zip(out, texts, strict=True):
        codes = np.frombuffer((t or "").encode("utf-16-le"), np.uint16)
        row += np.bincount(np.arange(len(codes)) % dims, weights=(codes % 31) / 31, minlength=dims)
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


def encode(df: DataFrame, text: str, encoder: Encoder = code_point_vectors, into: str = "embedding") -> DataFrame:
    """Add vectors from a pluggable encoder of text batches; a model is loaded by the encoder once per worker."""

    @F.pandas_udf("array<float>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(encoder([x or "" for x in s]).astype(np.float32)))

    return df.withColumn(into, work(F.col(text)))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def l2_normalize(v: Column | str) -> Column:
    """x / (|x| + 1e-9)."""
    c = F.col(v) if isinstance(v, str) else v
    return T.let(norm(c) + 1e-9, lambda n: F.transform(c, lambda x: x.cast("double") / n))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean of token vectors for each text, by dimension; partial sums are made before the shuffle."""
    rows = tokens.filter(F.col(mask)).select(key, F.posexplode(vector).alias("dim", "x"))
    means = rows.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled"))


class _Nearest:
    """The best rows of a cell for each of its queries."""

    def __init__(self, queries: pa.Table, k: int, metric: str):
        self.k, self.metric = k, metric
        self.names = queries.column("q").combine_chunks()
        self.y = matrix(queries.column("y").combine_chunks())
        self.lengths = np.linalg.norm(self.y, axis=1)[:, None]
        self.least = np.full(len(self.names), -np.inf)
        self.kept: list[pa.Table] = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(SCORES // len(self.names), self.k, 1)
        for at in range(0, len(batch), step):
            self._score(batch.slice(at, step))
        return iter(())

    def _score(self, batch: pa.RecordBatch) -> None:
        ids, x = batch.column("id"), matrix(batch.column("x"))
        dims = min(x.shape[1], self.y.shape[1])
        scores = self.y[:, :dims] @ x[:, :dims].T
        if self.metric == "cosine":
            scores /= self.lengths * np.linalg.norm(x, axis=1)[None, :] + 1e-9
        scores = scores.round(12)  # equal vectors tie whatever their place
        if scores.shape[1] >= self.k:  # what is less than the k-th best of this batch, or of an earlier one, is out
            np.maximum(self.least, np.partition(scores, -self.k, axis=1)[:, -self.k], out=self.least)
        q, at = np.nonzero(scores >= self.least[:, None])
        self.kept.append(pa.table({"q": pa.array(q), "id": ids.take(pa.array(at)), "score": scores[q, at]}))
        if sum(map(len, self.kept)) > 4 * self.k * len(self.names) + 65_536:
            self.kept = [self._best()]

    def _best(self) -> pa.Table:
        found = pa.concat_tables(self.kept)
        found = found.take(pa.compute.sort_indices(found, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
        q = found.column("q").to_numpy()
        return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.k))

    def result(self) -> Iterator[pa.RecordBatch]:
        found = self._best()
        out = pa.table({"q": self.names.take(found.column("q").combine_chunks()), "id": found.column("id"), "score": found.column("score")})
        yield from out.to_batches(max_chunksize=65_536)


def _bands(norms: DataFrame, rows_each: int, bands_each: int = 8) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Blocks of rows with about equal norms, the longest vectors first: (norms with `block`, [(band, blocks up to its end, rows up to its end)]).

    A band holds the norms between two powers of 2 ** (1 / bands_each), so there are few at any size of the table.
    """
    band = F.coalesce(F.floor(F.log2(F.when(F.col("norm") > 0, F.col("norm"))) * bands_each), F.lit(-10_000)).cast("int")
    rows = norms.withColumn("band", band)
    counts = sorted(((r["band"], r["count"]) for r in rows.groupBy("band").count().collect()), reverse=True)  # a row for each band
    starts, ends, done, seen = [], [], 0, 0
    for b, count in counts:
        n = -(-count // rows_each)
        starts.append((b, done, n))
        done, seen = done + n, seen + count
        ends.append((b, done, seen))
    told = F.broadcast(norms.sparkSession.createDataFrame(starts, "band int, _start long, _n long"))  # a row for each band
    rows = rows.join(told, "band").withColumn("block", F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_n"))).drop("band", "_start", "_n", "norm")
    return rows, ends


def top_k(index: DataFrame, queries: DataFrame, k: int, metric: str = "dot", key: str = "id", query_key: str = "query_id", vector: str = "embedding", query_block: int | None = None, index_block: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the exact k best of the whole index for every query. Ties go to the smaller id.

    A grid of query blocks and index blocks: each cell keeps the k best of each of its queries, and these are ranked over
    the cells. No query passes the driver, and the plan is the same for any number of blocks. Blocks grow with the number of queries up to a bound, so that few copies
    of the index are shuffled, in the type that it has.
    With `metric="dot"` the index lies in blocks by length of its vectors, the longest first. The first blocks give each query a k-th best
    score to begin with; as no score exceeds the product of the two lengths, a query meets only the blocks
    that could better it, and cells without such queries are not made. Null vectors take no part; shorter ones count as filled with zeros.
    """
    y = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("y")).filter("y is not null")
    x = index.select(F.col(key).alias("id"), F.col(vector).alias("x")).filter("x is not null")
    schema = f"q {dict(y.dtypes)['q']}, id {dict(x.dtypes)['id']}, score double"
    y = cut(y)  # queries may be costly to make, and are copied for each block of the index
    n = y.count()
    query_block = query_block or min(LARGE_QUERY_BLOCK, max(QUERY_BLOCK, -(-n // QUERY_BLOCKS)))
    q_blocks = max(1, -(-n // query_block))
    index_block = index_block or (LARGE_INDEX_BLOCK if metric != "dot" and q_blocks >= QUERY_BLOCKS else INDEX_BLOCK)
    y = y.withColumn("qb", dealt("q", q_blocks))
    x, bands = _bands(x.withColumn("norm", norm("x") if metric == "dot" else F.lit(1.0)), index_block)
    blocks = bands[-1][1] if bands else 1

    def search(asks: DataFrame, rows: DataFrame) -> DataFrame:
        """asks: q, y, qb, from, to (blocks that the query meets); rows: id, x, block."""
        left = asks.withColumn("block", F.explode(F.sequence("from", F.col("to") - 1)))
        reach = asks.groupBy("qb").agg(F.max("to").alias("_to"))  # a row for each block of queries
        right = rows.withColumn("qb", every(q_blocks)).join(reach, "qb").filter(F.col("block") < F.col("_to")).drop("_to")
        cell = (F.col("qb") * blocks + F.col("block")).alias("cell")
        return meet(left.select(cell, "q", "y"), right.select(cell, "id", "x"), lambda t: _Nearest(t, k, metric), schema)

    order = [F.desc("score"), F.col("id")]
    first = next((end for _, end, seen in bands if seen >= max(4 * k, index_block)), blocks)
    if metric != "dot" or blocks <= 2 * first:
        found = search(y.withColumn("from", F.lit(0).cast("long")).withColumn("to", F.lit(blocks).cast("long")), x)
    else:
        seed = y.withColumn("from", F.lit(0).cast("long")).withColumn("to", F.lit(first).cast("long"))
        some = cut(rank(search(seed, x.filter(F.col("block") < first)), ["q"], order, k).drop("rank"))
        least = some.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        # the lowest band whose longest vectors reach the score, and the blocks down to it
        span = range(bands[-1][0], bands[0][0] + 1)
        down_to = {b: max((end for band, end, _ in bands if band >= b), default=0) for b in span}
        told = F.broadcast(index.sparkSession.createDataFrame(list(down_to.items()), "band int, to long"))
        need = F.when((F.col("n") < k) | (F.col("least") <= 0) | (norm("y") == 0), bands[-1][0]).otherwise(F.floor(F.log2((F.col("least") - 1e-9) / norm("y")) * 8 - 1e-6))
        asks = y.join(least, "q", "left").withColumn("band", F.least(F.lit(bands[0][0] + 1), F.greatest(F.lit(bands[-1][0]), F.coalesce(need, F.lit(bands[-1][0]))))).withColumn("band", F.col("band").cast("int"))
        asks = asks.join(told, "band").filter(F.col("to") > first).select("q", "y", "qb", F.lit(first).cast("long").alias("from"), "to")
        found = some.unionByName(search(asks, x.filter(F.col("block") >= first)))
    return rank(found, ["q"], order, k).select(F.col("q").alias(query_key), "rank", F.col("id").alias(key), "score")


def lexical_score(query: Column, title: Column, id: Column, kind: str = "phrase", title_sw: Column | None = None, aliases: Column | None = None) -> Column:
    """How many of a query's tokens an item's names hold, by weight, over the number of tokens.

    `phrase`: title 2, id 1, and 4 if the whole title stands in the query. `aliases`: title 2, other title 3, aliases 3, id 1.
    """
    def score(q: Column) -> Column:
        shared = lambda c: F.size(F.array_intersect(q, T.tokens(c, "hybrid")))
        hits = 2.0 * shared(title) + shared(F.replace(id, F.lit("-"), F.lit(" ")))
        if kind == "phrase":
            low = F.lower(F.coalesce(title, F.lit("")))
            hits = hits + F.when((low != "") & F.contains(F.lower(query), low), 4.0).otherwise(0.0)
        else:
            hits = sum(w * shared(c) for c, w in _fields(title, id, title_sw, aliases))
        return F.when(F.size(q) > 0, hits / F.size(q)).otherwise(F.lit(0.0))

    return T.let(T.tokens(query, "hybrid"), score)


def hybrid(candidates: DataFrame, queries: DataFrame, meta: DataFrame, weight: float, k: int, kind: str = "phrase") -> DataFrame:
    """Rerank semantic candidates (query_id, id, score) by score + weight * lexical score; candidates are the best few of the
    index, or all of it for the full variant. meta: id, title and for `aliases` title_sw, aliases_sw."""
    rows = candidates.select("query_id", "id", F.col("score").alias("semantic_score")).join(queries.select("query_id", "query"), "query_id").join(meta, "id")
    also = {"title_sw": F.col("title_sw"), "aliases": F.col("aliases_sw")} if kind == "aliases" else {}
    rows = rows.withColumn("lexical_score", lexical_score(F.col("query"), F.col("title"), F.col("id"), kind, **also))
    rows = rows.withColumn("score", F.col("semantic_score") + F.lit(weight) * F.col("lexical_score"))
    out = rank(rows, ["query_id"], [F.desc("score"), F.col("id")], k)
    return out.select("query_id", "rank", "id", "score", "semantic_score", "lexical_score")


def _fields(title: Column, id: Column, title_sw: Column, aliases: Column) -> list[tuple[Column, float]]:
    """What `aliases` scores by: the texts of an item and the weight of a word in each."""
    return [(title, 2.0), (title_sw, 3.0), (F.array_join(aliases, " "), 3.0), (F.replace(id, F.lit("-"), F.lit(" ")), 1.0)]


def promising(near: DataFrame, queries: DataFrame, meta: DataFrame, weight: float, k: int) -> DataFrame:
    """(query_id, id): items besides the `near` ones that can be among the k best by score + weight * lexical score.

    Two orders meet as in the threshold algorithm. `near` holds the first items of each query by score, so what is not in it
    scores at most what its last one does; and its k-th best by the whole score is to be beaten. The gap gives the
    lexical score that an item needs. A query's words are taken from the rarest on, by the postings of names, and each
    gives at most its largest weight: once the words that are left cannot make up the need, items that hold only those
    are out, so the postings of frequent words are not read.
    """
    ranked = hybrid(near, queries, meta, weight, k, "aliases")
    bound = near.groupBy("query_id").agg(F.min("score").alias("_last"))
    goal = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
    need = F.when(F.col("_n") >= k, (F.col("_kth") - F.col("_last")) / F.lit(weight) - 1e-9).otherwise(F.lit(0.0))
    need = bound.join(goal, "query_id", "left").select("query_id", F.coalesce(need, F.lit(0.0)).alias("_need"))
    weighed = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))
    one = F.explode(F.concat(*[F.transform(T.tokens(c, "hybrid"), weighed(w)) for c, w in _fields(F.col("title"), F.col("id"), F.col("title_sw"), F.col("aliases_sw"))]))
    postings = meta.select("id", one.alias("p")).groupBy("p.term", "id").agg(F.sum("p.w").alias("w"))
    asked = queries.select("query_id", T.tokens("query", "hybrid").alias("_t")).select("query_id", F.size("_t").alias("_size"), F.explode("_t").alias("term"))
    words = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.max("w").alias("_most"))
    rest = Window.partitionBy("query_id").orderBy(F.desc("_df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)  # a query's few words, the rarest last
    asked = asked.join(words, "term").withColumn("_can", F.sum(F.col("_most") / F.col("_size")).over(rest))
    useful = asked.join(need, "query_id").filter(F.col("_can") >= F.col("_need")).select("query_id", "term", "_need")
    found = useful.join(postings.select("term", "id"), "term").select("query_id", "id", "_need").distinct()
    found = found.join(near.select("query_id", "id"), ["query_id", "id"], "left_anti")
    lexical = found.join(queries.select("query_id", "query"), "query_id").join(meta, "id")
    lexical = lexical.withColumn("_lexical", lexical_score(F.col("query"), F.col("title"), F.col("id"), "aliases", title_sw=F.col("title_sw"), aliases=F.col("aliases_sw")))
    return lexical.filter(F.col("_lexical") >= F.col("_need")).select("query_id", "id")


def hybrid_full(index: DataFrame, queries: DataFrame, meta: DataFrame, weight: float, k: int, ahead: int = 20) -> DataFrame:
    """`hybrid` with `aliases` over the whole index: the k best of all items, exactly. index: id, embedding; queries: query_id, query,
    embedding. The ahead * k nearest are met by their vectors; of the rest only the `promising` are."""
    near = cut(top_k(index, queries, ahead * k).select("query_id", "id", "score"))
    more = promising(near, queries, meta, weight, k).join(index.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    more = more.select("query_id", "id", F.round(dot("_q", "embedding"), 12).alias("score"))
    return hybrid(near.unionByName(more), queries, meta, weight, k, "aliases")


def score_map(ranked: DataFrame, most: int = 200) -> DataFrame:
    """Scores clamped to 0..1, the best `most` of each query."""
    return ranked.filter(F.col("rank") <= most).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def materialize(ranked: DataFrame, items: DataFrame, fallback: DataFrame) -> DataFrame:
    """Ranked ids as items, unknown ids dropped; queries that are left with nothing take the fallback's ranks. All ranked
    frames are (query_id, rank, id)."""
    known = ranked.select("query_id", "rank", "id").join(items.select("id", "title"), "id")
    rest = fallback.select("query_id", "rank", "id").join(known.select("query_id").distinct(), "query_id", "left_anti").join(items.select("id", "title"), "id")
    return known.select("query_id", "rank", "id", "title").unionByName(rest.select("query_id", "rank", "id", "title"))


def eval_hits(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, expected_id, hit1, hit3, hit5) for every expected query, found or not."""
    place = ranked.select("query_id", F.col("id").alias("expected_id"), "rank")
    rows = expected.join(place, ["query_id", "expected_id"], "left")
    best = rows.groupBy("query_id", "expected_id").agg(F.min("rank").alias("rank"))
    return best.select("query_id", "expected_id", *[F.coalesce((F.col("rank") <= n).cast("int"), F.lit(0)).alias(f"hit{n}") for n in (1, 3, 5)])


def eval_report(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(f"hit{n}").alias(f"accuracy{n}") for n in (1, 3, 5)])
