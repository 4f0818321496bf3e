"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from .hard_negatives import FROM, NEGATIVES, OF, POSITIVES, TO, UNIT
from .near_join import LEAST, WORDS
from .phrases import LEAST as LEAST_PHRASE
from .phrases import PARTS
from .secret_scan import ALLOWED, CANDIDATE, KINDS, LEAST_LETTERS, LEAST_ONE_CASE, WINDOW
from .secret_scan import LEAST as LEAST_ENTROPY

# CRC-32 by half bytes: the table follows from the polynomial.
_TABLE = []
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE.append(_c)

_NIBBLES = "list_transform(range(0, len(h)), lambda i: CAST(strpos('0123456789ABCDEF', h[(i // 2) * 2 + 2 - i % 2]) - 1 AS BIGINT))"
_CRC = f"CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, {_NIBBLES}), lambda a, x: xor(a >> 4, {_TABLE}[CAST(xor(a, x) & 15 AS INT) + 1])), 4294967295) END"

SHARDS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT *, string_split(hex(encode(text)), '') AS h FROM d),
 s AS (SELECT doc_id, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS size, {_CRC} AS text_crc32 FROM b),
 o AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM s),
 p AS (SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INT) AS shard FROM o)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""


def _spans(kind: str, pattern: str) -> str:
    """Spans of all matches: a match's place follows from the lengths of the gaps and matches before it."""
    return f"""SELECT doc_id, '{kind}' AS kind, m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
 FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d))"""


_ENTROPY = f"list_max(list_transform(range(1, length({{0}}) - {WINDOW} + 2), lambda i: list_entropy(string_split(substring({{0}}, i, {WINDOW}), ''))))"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
_LISTED = f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {_RANK}, e), '')"

SECRETS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 a AS ({_spans('assign', _ASSIGN + '[A-Za-z0-9+/_.=-]+')}), k AS ({_spans('access', 'AKIA[A-Z0-9]+')}), x AS ({_spans('hex', '[0-9a-f]{16,}')}), c AS ({_spans('candidate', CANDIDATE.partition(')')[2])}),
 base AS (SELECT doc_id, kind, s, s + length(m) AS e FROM a WHERE length(regexp_replace(m, '^{_ASSIGN}', '')) >= 12 UNION ALL SELECT doc_id, kind, s, s + length(m) FROM k WHERE length(m) >= 18 UNION ALL SELECT doc_id, kind, s, s + length(m) FROM x),
 random AS (SELECT doc_id, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') AND regexp_matches(m, '[0-9]') THEN 'entropy_hex' ELSE 'entropy_alnum' END AS kind, s, s + length(m) AS e, m FROM c WHERE regexp_matches(m, '[0-9]|[a-z].*[A-Z].*[A-Z]') AND NOT regexp_matches(m, '{ALLOWED}')),
 scored AS (SELECT doc_id, kind, s, e, CASE WHEN kind = 'entropy_hex' THEN {_ENTROPY.format('lower(m)')} WHEN regexp_matches(m, '^([0-9a-z]+|[0-9A-Z]+)$') OR regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN {_ENTROPY.format('m')} ELSE 0 END AS h,
  CASE WHEN kind = 'entropy_hex' THEN {LEAST_ENTROPY['entropy_hex']} WHEN regexp_matches(m, '^([0-9a-z]+|[0-9A-Z]+)$') THEN {LEAST_ONE_CASE} WHEN regexp_matches(m, '[0-9]') THEN {LEAST_ENTROPY['entropy_alnum']} ELSE {LEAST_LETTERS} END AS least FROM random),
 fresh AS (SELECT doc_id, kind, s, e FROM scored r WHERE h >= least - 1e-9 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND r.e <= b.e)),
 b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_LISTED} AS listed FROM base GROUP BY doc_id),
 al AS (SELECT doc_id, {_LISTED} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM fresh) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (doc_id) LEFT JOIN al USING (doc_id)"""

NEAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w, coalesce(text, '') AS text FROM documents),
 sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [chr(1) || text] ELSE list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END AS ss FROM d), unnest(ss) AS u(s)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 near AS MATERIALIZED (SELECT x, y, c = p.n AND c = q.n AS same FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= {LEAST} * (p.n + q.n - c) - 1e-9),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN near e ON e.x = r.y),
 classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
 SELECT d.doc_id, least(d.doc_id, coalesce(min(e.y) FILTER (e.same), d.doc_id)) AS copy_id, any_value(k.class_id) AS class_id, count(e.y) AS n_links FROM d LEFT JOIN near e ON e.x = d.doc_id JOIN classes k ON k.x = d.doc_id GROUP BY d.doc_id"""

#: Pages whose main text is one article element without parts that are left out; each tag but inline ones ends a block.
MAIN_TEXT = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
 t AS (SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '</?(?:b|i|em|strong|a|span)(?: [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a),
 s AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g')) AS text FROM t) SELECT *, length(text) AS n_chars FROM s"""

_CUT = "(1000000::HUGEINT * a * a) // (CAST({l} AS HUGEINT) * {r})"
PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, w[i:i + k - 1] AS g FROM w, unnest(range(1, len(w) + 1)) AS s(i), (VALUES (1), (2), (3)) AS t(k) WHERE i + k - 1 <= len(w)),
 f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
 c AS MATERIALIZED (SELECT * FROM f WHERE a >= {LEAST_PHRASE} AND len(g) > 1),
 held AS (SELECT lang, h, max(a) AS most FROM (SELECT lang, g[1:2] AS h, a FROM c WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE len(g) = 3) GROUP BY ALL),
 s AS (SELECT c.lang, c.g, c.a, x.a AS l1, y.a AS r1, u.a AS l2, v.a AS r2 FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:1] JOIN f y ON y.lang = c.lang AND y.g = c.g[2:] LEFT JOIN f u ON len(c.g) = 3 AND u.lang = c.lang AND u.g = c.g[1:2] LEFT JOIN f v ON len(c.g) = 3 AND v.lang = c.lang AND v.g = c.g[3:3] LEFT JOIN held h ON h.lang = c.lang AND h.h = c.g WHERE coalesce(100 * most < {PARTS} * c.a, true)),
 t AS (SELECT *, {_CUT.format(l="l1", r="r1")} AS s1, {_CUT.format(l="l2", r="r2")} AS s2 FROM s),
 b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, CAST(CASE WHEN s2 < s1 THEN s2 ELSE s1 END AS BIGINT) AS score FROM t)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= 2000"""

NEGATIVE_EXAMPLES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({UNIT} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
 n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND {FROM} * positive_score <= {OF} * score AND {OF} * score <= {TO} * positive_score)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank, negative_id, positive_score, negative_score FROM n QUALIFY rank <= {NEGATIVES}"""

ORACLES = {"op12_hard_negatives": NEGATIVE_EXAMPLES, "op8_main_text": MAIN_TEXT, "op3_secret_scan": SECRETS, "op4_byte_shards": SHARDS, "op5_near_duplicates": NEAR, "op11_collocations": PHRASES}
