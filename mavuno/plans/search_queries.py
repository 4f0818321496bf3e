"""Queries for keyword search and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as S
from .inputs import ITEMS, items, table
from .registry import query


def asked(spark, sf_dir) -> DataFrame:
    """Search queries from the benchmark: two words of each passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), 2, 2), " ").alias("query"))


def synonyms(spark, sf_dir) -> DataFrame:
    """(term, alt, place) from the benchmark: the second word of a passage stands for its fourth and fifth."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower).alias("w"))
    rows = w.select(F.get("w", F.lit(1)).alias("term"), F.posexplode(F.slice("w", 4, 2)).alias("place", "alt"))
    return rows.groupBy("term", "alt").agg(F.min("place").alias("place"))


ASKED = "asked AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{4,}')[2:3], ' ') AS query FROM benchmark)"
SYNONYMS = """bw AS (SELECT list_transform(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda x: lower(x)) AS w FROM benchmark),
 synonyms AS (SELECT term, alt, min(place) AS place FROM (SELECT w[2] AS term, unnest(w[4:5]) AS alt, unnest(range(0, len(w[4:5]))) AS place FROM bw) GROUP BY ALL)"""
TEXTS = "texts AS (SELECT id, doc_id, title, lower(title) AS t, lower(coalesce(content_en, content_sw, '')) AS b FROM items)"
TERMS = """orig AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM asked),
 terms AS (SELECT query_id, term, max(o) AS original FROM (SELECT query_id, term, 1 AS o FROM orig UNION ALL SELECT query_id, alt, 0 FROM orig JOIN synonyms USING (term)) GROUP BY ALL)"""
POSTINGS = "bags AS (SELECT id, unnest(regexp_extract_all(t || chr(10) || b, '[a-z0-9]{2,}')) AS term FROM texts), postings AS (SELECT term, id, count(*) AS tf FROM bags GROUP BY ALL)"
_ALL = f"{ITEMS}, {ASKED}, {SYNONYMS}, {TEXTS}, {TERMS}, {POSTINGS}"


@query(f"WITH {_ALL} SELECT * FROM postings")
def se_inverted_index(spark, sf_dir):
    return S.postings(items(spark, sf_dir))


@query(f"WITH {_ALL} SELECT DISTINCT query_id, id FROM postings JOIN terms USING (term)")
def se_lookup_any(spark, sf_dir):
    terms = S.expand(S.query_terms(asked(spark, sf_dir)), synonyms(spark, sf_dir))
    return S.lookup_any(S.postings(items(spark, sf_dir)), terms.select("query_id", "term"))


@query(f"WITH {_ALL} SELECT query_id, term, original = 1 AS original FROM terms")
def se_expand_terms(spark, sf_dir):
    return S.expand(S.query_terms(asked(spark, sf_dir)), synonyms(spark, sf_dir))


@query(
    f"""WITH {ASKED}, {SYNONYMS}, toks AS (SELECT query_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS p FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM asked)),
 f AS (SELECT query_id, alt, min((p, place)) AS first FROM toks JOIN synonyms USING (term) WHERE alt <> term GROUP BY ALL)
 SELECT query_id, CAST(rank AS INT) AS rank, alt FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, alt) AS rank FROM f) WHERE rank <= 6"""
)
def se_suggestions(spark, sf_dir):
    return S.suggestions(asked(spark, sf_dir), synonyms(spark, sf_dir))


_FAST = f"""WITH {_ALL}, c AS (SELECT DISTINCT query_id, id FROM postings JOIN terms USING (term)),
 s AS (SELECT c.query_id, c.id, x.title, sum(CASE WHEN contains(x.t, m.term) THEN CASE m.original WHEN 1 THEN 3.0 ELSE 2.0 END ELSE 0 END + CASE WHEN contains(x.b, m.term) THEN CASE m.original WHEN 1 THEN 1.0 ELSE 0.5 END ELSE 0 END) AS score
  FROM c JOIN terms m USING (query_id) JOIN texts x ON x.id = c.id GROUP BY ALL)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS INT) AS rank, id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0"""


@query(_FAST)
def se_fast_search(spark, sf_dir):
    return S.fast_search(items(spark, sf_dir), asked(spark, sf_dir), synonyms(spark, sf_dir))


@query(f"SELECT * FROM ({_FAST}) WHERE rank <= 3")
def se_shortlist(spark, sf_dir):
    return S.fast_search(items(spark, sf_dir), asked(spark, sf_dir), synonyms(spark, sf_dir), k=3)


@query(
    f"""WITH {ITEMS}, {ASKED}, {SYNONYMS}, {TEXTS}, own AS (SELECT query_id, lower(trim(query)) AS term FROM asked), ph AS (SELECT DISTINCT query_id, term FROM (SELECT * FROM own UNION ALL SELECT query_id, alt FROM own JOIN synonyms USING (term)) WHERE term <> ''),
 s AS (SELECT query_id, id, title, sum(CASE WHEN contains(t, term) THEN 3 ELSE 0 END + CASE WHEN contains(b, term) THEN 1 ELSE 0 END) AS score FROM texts JOIN ph ON contains(t, term) OR contains(b, term) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INT) AS rank, id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20"""
)
def se_phrase_search(spark, sf_dir):
    return S.phrase_search(items(spark, sf_dir), asked(spark, sf_dir), synonyms(spark, sf_dir))


@query(
    f"""WITH {ITEMS}, w AS (SELECT id, split_part(id, '-', 1) AS family, title, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS ws FROM items),
 s AS (SELECT a.id, o.id AS other, o.title, len(list_intersect(a.ws, o.ws)) + CASE WHEN a.family = o.family THEN 2 ELSE 0 END AS score FROM w a JOIN w o ON a.id <> o.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, title, other) AS rank FROM s WHERE score > 0)
 SELECT id, CAST(rank AS INT) AS rank, other, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 3"""
)
def se_related(spark, sf_dir):
    return S.related(items(spark, sf_dir))


_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ0-9'']+"


@query(
    f"""WITH {ITEMS}, {ASKED}, {TEXTS}, bag AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(b, '{_WORD}')) AS term FROM texts) GROUP BY ALL),
 q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{_WORD}')) AS term FROM asked) GROUP BY ALL),
 p AS (SELECT query_id, id, times * tf AS part FROM q JOIN bag USING (term) UNION ALL SELECT query_id, id, times * 0.75 FROM q JOIN texts ON contains(t, term)),
 s AS (SELECT query_id, id, CAST(sum(part) AS DOUBLE) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 3"""
)
def se_tf_answer(spark, sf_dir):
    return S.tf_answers(items(spark, sf_dir), asked(spark, sf_dir))


@query(
    f"""WITH {ITEMS}, {ASKED}, {TEXTS}, q AS (SELECT query_id, lower(query) AS q FROM asked WHERE query <> ''), s AS (SELECT query_id, id, len(string_split(t || ' ' || b, q)) - 1 + CASE WHEN contains(t, q) THEN 1 ELSE 0 END AS score FROM texts JOIN q ON contains(t || ' ' || b, q)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 8"""
)
def se_phrase_prefilter(spark, sf_dir):
    return S.phrase_prefilter(items(spark, sf_dir), asked(spark, sf_dir))


@query(f"WITH {ITEMS}, {TEXTS} SELECT id, title FROM texts WHERE doc_id % 3 = 0 AND (contains(t, 'ther') OR contains(b, 'ther'))")
def se_saved_filter(spark, sf_dir):
    its = items(spark, sf_dir)
    return S.saved_filter(its, its.filter(F.col("doc_id") % 3 == 0), "Ther ").select("id", "title")
