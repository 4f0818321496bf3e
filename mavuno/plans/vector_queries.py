"""Queries for embeddings, hybrid ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from ..operators import vectors as V
from .inputs import ITEMS, documents, items, table
from .registry import query
from .search_queries import ASKED, asked
from .text_queries import SQUASH


def index(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def questions(spark, sf_dir) -> DataFrame:
    """Every hundredth vector, as the query set."""
    return index(spark, sf_dir).filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")


@query(
    f"""WITH {ITEMS} SELECT id, {SQUASH("'passage: ' || title || '. ' || coalesce(content_en, '')")} AS plain, {SQUASH("'passage: ' || title || '. ' || coalesce(content_sw, '') || '. English reference: ' || title || '. ' || coalesce(content_en, '')")} AS bilingual,
 {SQUASH("'passage: ' || title || '. ' || title || '. ' || coalesce(content_en, '')")} AS doubled, {SQUASH("'passage: ' || title || '. ' || source_file || ', ' || id || '. ' || coalesce(content_en, '')")} AS aliases, 'query: ' || title AS q FROM items"""
)
def em_passage_text(spark, sf_dir):
    t, en, sw = F.col("title"), F.col("content_en"), F.col("content_sw")
    return items(spark, sf_dir).select(
        "id",
        V.passage_text(t, en).alias("plain"),
        V.passage_text(t, sw, "bilingual", other=en).alias("bilingual"),
        V.passage_text(t, en, "doubled").alias("doubled"),
        V.passage_text(t, en, "aliases", aliases=F.array("source_file", "id")).alias("aliases"),
        V.query_text(t).alias("q"),
    )


_UNITS = "CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END"  # of UTF-16


@query(
    rf"""WITH u AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: {_UNITS})) AS us FROM documents),
 p AS (SELECT doc_id, unnest(us) AS code, (generate_subscripts(us, 1) - 1) % 384 AS place FROM u), s AS (SELECT doc_id, place, sum((code % 31) / 31.0::DOUBLE) AS x FROM p GROUP BY ALL),
 a AS (SELECT u.doc_id, r.place, coalesce(s.x, 0) AS x FROM u CROSS JOIN (SELECT unnest(range(384)) AS place) r LEFT JOIN s ON s.doc_id = u.doc_id AND s.place = r.place), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM a GROUP BY doc_id)
 SELECT doc_id, string_agg(CAST(round(CAST(CAST(x / (norm + 1e-9) AS FLOAT) AS DOUBLE) * 10000) AS INT), ',' ORDER BY place) AS embedding FROM a JOIN n USING (doc_id) GROUP BY doc_id"""
)
def em_encode(spark, sf_dir):
    """Vectors of the fallback encoder, in ten thousandths."""
    coded = V.encode(documents(spark, sf_dir).select("doc_id", "text"), "text")
    return coded.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string")), ",").alias("embedding"))


@query("SELECT label AS text_id, round(avg(embedding[1]), 6) AS first, round(avg(embedding[64]), 6) AS last, 64 AS dims FROM embeddings WHERE vec_id % 3 > 0 GROUP BY label")
def em_mean_pool(spark, sf_dir):
    tokens = index(spark, sf_dir).select(F.col("label").alias("text_id"), "embedding", (F.col("id") % 3 > 0).alias("mask"))
    pooled = V.mean_pool(tokens, "text_id", "embedding", "mask")
    return pooled.select("text_id", F.round(F.get("pooled", F.lit(0)), 6).alias("first"), F.round(F.element_at("pooled", -1), 6).alias("last"), F.size("pooled").alias("dims"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"SELECT vec_id AS id, round({_NORM}, 6) AS norm, round(embedding[1] / ({_NORM} + 1e-9), 6) AS first FROM embeddings")
def em_l2_normalize(spark, sf_dir):
    return index(spark, sf_dir).select("id", F.round(V.norm("embedding"), 6).alias("norm"), F.round(F.get(V.l2_normalize("embedding"), F.lit(0)), 6).alias("first"))


_DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"
_QN, _EN = _NORM.replace("embedding", "q.embedding"), _NORM.replace("embedding", "e.embedding")
_DOTS = f"SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT}, 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"
_COSINES = f"SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT} / ({_QN} * {_EN} + 1e-9), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"
_TOP = lambda s, k: f"SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({s})) WHERE rank <= {k}"


@query(f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_TOP(_DOTS, 10)})")
def em_dot_topk(spark, sf_dir):
    return V.top_k(index(spark, sf_dir), questions(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_TOP(_COSINES, 10)})")
def em_cosine_topk(spark, sf_dir):
    return V.top_k(index(spark, sf_dir), questions(spark, sf_dir), 10, "cosine").withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, rank, id, round(greatest(0, least(1, score)), 6) AS score FROM ({_TOP(_COSINES, 200)})")
def em_score_map(spark, sf_dir):
    return V.score_map(V.top_k(index(spark, sf_dir), questions(spark, sf_dir), 200, "cosine")).withColumn("score", F.round("score", 6))


def _named(spark, sf_dir) -> DataFrame:
    """The index with items' names: vector n belongs to the item of document n."""
    its = items(spark, sf_dir)
    return index(spark, sf_dir).withColumnRenamed("id", "doc_id").join(its, "doc_id").select("id", "title", "doc_id", "embedding", F.col("source_file").alias("title_sw"), F.array("image").alias("aliases_sw"))


def _typed(spark, sf_dir) -> DataFrame:
    """Queries with a text and a vector: the benchmark's words, and the vector of the same number."""
    q = asked(spark, sf_dir)
    word = F.regexp_extract("query", "^[A-Za-z]+", 0)
    q = q.select("query_id", F.concat(word, F.lit(" herb disease "), F.col("query_id")).alias("query"))
    return q.join(index(spark, sf_dir).select(F.col("id").alias("query_id"), "embedding"), "query_id")


_NAMED = f"{ITEMS}, {ASKED}, named AS (SELECT i.id, i.title, i.doc_id, e.embedding, i.source_file AS title_sw, [i.image] AS aliases_sw FROM embeddings e JOIN items i ON i.doc_id = e.vec_id), typed AS (SELECT a.query_id, regexp_extract(a.query, '^[A-Za-z]+') || ' herb disease ' || a.query_id AS query, e.embedding FROM asked a JOIN embeddings e ON e.vec_id = a.query_id)"
_TOK = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-ZÀ-ÿ0-9'']+'), lambda t: lower(t)), lambda t: length(t) > 1))"
_SH = lambda x: f"len(list_intersect({_TOK('query')}, {_TOK(x)}))"
_LEX_A = f"(2.0 * {_SH('title')} + {_SH('''replace(id, '-', ' ')''')} + CASE WHEN title <> '' AND contains(lower(query), lower(title)) THEN 4.0 ELSE 0 END) / len({_TOK('query')})"
_LEX_B = f"(2.0 * {_SH('title')} + 3.0 * {_SH('title_sw')} + 3.0 * {_SH('coalesce(aliases_sw[1], chr(32))')} + {_SH('''replace(id, '-', ' ')''')}) / len({_TOK('query')})"


def _hybrid_sql(lex: str, weight: float, top: int | None, k: int) -> str:
    cut = f"WHERE r <= {top}" if top else ""
    return f"""WITH {_NAMED}, d AS (SELECT q.query_id, q.query, e.id, e.title, e.title_sw, e.aliases_sw, round({_DOT}, 12) AS sem FROM typed q, named e),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, id) AS r FROM d) {cut}), l AS (SELECT *, CAST({lex} AS DOUBLE) AS lex FROM c),
 f AS (SELECT *, sem + {weight} * lex AS final FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM f)
 SELECT query_id, CAST(rank AS INT) AS rank, id, round(final, 6) AS score, round(sem, 6) AS semantic_score, round(lex, 6) AS lexical_score FROM k WHERE rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("score", "semantic_score", "lexical_score")})


@query(f"SELECT 'phrase' AS kind, * FROM ({_hybrid_sql(_LEX_A, 0.08, 50, 5)}) UNION ALL SELECT 'aliases', * FROM ({_hybrid_sql(_LEX_B, 0.08, 50, 5)})")
def em_hybrid_rerank(spark, sf_dir):
    named, typed = _named(spark, sf_dir), _typed(spark, sf_dir)
    near = V.top_k(named, typed, 50)
    one = V.hybrid(near, typed, named.select("id", "title"), 0.08, 5).withColumn("kind", F.lit("phrase"))
    two = V.hybrid(near, typed, named.select("id", "title", "title_sw", "aliases_sw"), 0.08, 5, "aliases").withColumn("kind", F.lit("aliases"))
    return _rounded(one.unionByName(two))


@query(_hybrid_sql(_LEX_B, 0.08, None, 10))
def em_hybrid_full(spark, sf_dir):
    named, typed = _named(spark, sf_dir), _typed(spark, sf_dir)
    return _rounded(V.hybrid_full(named, typed, named.select("id", "title", "title_sw", "aliases_sw"), 0.08, 10))


@query(
    f"""WITH {_NAMED}, r AS ({_TOP(_DOTS, 5)}), k AS (SELECT r.query_id, r.rank, n.id, n.title FROM r JOIN named n ON n.doc_id = r.id),
 w AS (SELECT vec_id AS query_id, CAST(1 AS INT) AS rank, 'herb-0' AS id FROM embeddings WHERE vec_id % 50 = 0)
 SELECT * FROM k UNION ALL SELECT w.query_id, w.rank, w.id, i.title FROM w JOIN items i ON i.id = w.id WHERE w.query_id NOT IN (SELECT query_id FROM k)"""
)
def em_materialize(spark, sf_dir):
    named = _named(spark, sf_dir)
    ranked = V.top_k(index(spark, sf_dir), questions(spark, sf_dir), 5).withColumnRenamed("id", "doc_id")
    ranked = ranked.join(named.select("doc_id", "id"), "doc_id").select("query_id", "rank", "id")
    fallback = index(spark, sf_dir).filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.lit("herb-0").alias("id"))
    return V.materialize(ranked, items(spark, sf_dir), fallback)


@query(
    f"""WITH p AS (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 u AS (SELECT user_id, pow(0.85, back) * CASE WHEN back = n - 1 THEN 1 ELSE 0.15 END AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM p JOIN embeddings USING (vec_id)),
 q AS (SELECT user_id, list(value ORDER BY dim) AS embedding FROM (SELECT user_id, dim, sum(w * x) AS value FROM u GROUP BY ALL) GROUP BY user_id), s AS (SELECT q.user_id, e.vec_id AS id, round({_DOT} / ({_QN} * {_EN} + 1e-9), 12) AS score FROM q, embeddings e),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM s) SELECT user_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM k WHERE rank <= 8"""
)
def em_for_you(spark, sf_dir):
    """What is nearest to the moving average of what a user has read."""
    idx = index(spark, sf_dir)
    n = idx.count()
    reads = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % n).alias("id"), "ts", "event_id")
    return V.top_k(idx, A.profile_vectors(reads, idx), 8, "cosine", query_key="user_id").withColumn("score", F.round("score", 6))


@query(
    f"""WITH r AS ({_TOP(_COSINES, 5)}), x AS (SELECT DISTINCT query_id, (query_id + CASE WHEN query_id % 200 = 0 THEN 0 ELSE 1 END) AS expected_id FROM r), b AS (SELECT x.query_id, x.expected_id, min(r.rank) AS rank FROM x LEFT JOIN r ON r.query_id = x.query_id AND r.id = x.expected_id GROUP BY ALL)
 SELECT count(*) AS queries, avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS accuracy1, avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS accuracy3, avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS accuracy5 FROM b"""
)
def em_eval_hits(spark, sf_dir):
    q = questions(spark, sf_dir)
    expected = q.select("query_id", (F.col("query_id") + F.when(F.col("query_id") % 200 == 0, 0).otherwise(1)).alias("expected_id"))
    return V.eval_report(V.eval_hits(V.top_k(index(spark, sf_dir), q, 5, "cosine"), expected))


@query(f"SELECT e.vec_id AS id, round({_DOT} / ({_QN} * {_EN} + 1e-9), 6) AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id + 1")
def em_compare_models(spark, sf_dir):
    one = index(spark, sf_dir).select("id", "embedding")
    two = index(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return one.join(two, "id").select("id", F.round(V.cosine("other", "embedding"), 6).alias("cosine"))
