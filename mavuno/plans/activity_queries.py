"""Queries for browsing lists and user activity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import browse as B
from ..operators.ordered import shared_folder
from ..streaming import activity as S
from .inputs import ACTIVITY, ITEMS, activity, items, table
from .registry import ORACLES, query


@query(f"WITH {ITEMS} SELECT split_part(id, '-', 1) AS family, id, title, count(*) OVER (PARTITION BY split_part(id, '-', 1)) AS n, row_number() OVER (PARTITION BY split_part(id, '-', 1) ORDER BY title, id) AS place FROM items")
def br_family_lists(spark, sf_dir):
    return B.family_lists(items(spark, sf_dir))


_LETTER = "CASE WHEN regexp_matches(upper(substring(trim(title), 1, 1)), '[A-Z]') THEN upper(substring(trim(title), 1, 1)) ELSE '#' END"


@query(f"WITH {ITEMS} SELECT {_LETTER} AS letter, id, title, row_number() OVER (PARTITION BY {_LETTER} ORDER BY lower(title), id) AS place FROM items")
def br_az_groups(spark, sf_dir):
    return B.az_groups(items(spark, sf_dir))


_GROUPS = "', '".join(dict.fromkeys([*[k for k, _ in B.GROUPS], "general"]))


@query(f"SELECT g.grp, count(i.id) AS n, min(i.title) AS first_title FROM (SELECT unnest(['{_GROUPS}']) AS grp) g LEFT JOIN (WITH {ITEMS} SELECT i.id, i.title, x.grp FROM items i JOIN ({ORACLES['st_infer_group']}) x ON x.id = i.id WHERE i.id LIKE 'disease-%') i ON i.grp = g.grp GROUP BY g.grp")
def br_group_buckets(spark, sf_dir):
    return B.group_buckets(items(spark, sf_dir))


@query(f"WITH {ITEMS}, r AS (SELECT split_part(id, '-', 1) AS family, id, title, count(*) OVER (PARTITION BY split_part(id, '-', 1)) AS n, row_number() OVER (PARTITION BY split_part(id, '-', 1) ORDER BY id) - 1 AS p FROM items) SELECT family, id, title FROM r WHERE p = (19737 + CASE family WHEN 'principle' THEN 17 ELSE 0 END) % n")
def br_pick_of_day(spark, sf_dir):
    return B.pick_of_day(items(spark, sf_dir), F.to_date(F.lit("2024-01-15")))


@query(
    f"""WITH {ITEMS}, a AS (SELECT split_part(id, '-', 1) AS family, id FROM items), r AS (SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY md5('0:' || id), id) - 1 AS place, count(*) OVER (PARTITION BY family) AS n FROM a),
 s AS (SELECT family, id, (place + unnest(range(1, CAST(least(n - 1, 16) AS BIGINT) + 1))) % n AS other FROM r WHERE n >= 4), o AS (SELECT s.id, r.id AS choice FROM s JOIN r ON r.family = s.family AND r.place = s.other),
 d AS (SELECT id, choice FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('1:' || id || ':' || choice), choice) AS r FROM o) WHERE r < 4),
 b AS (SELECT id, choice, false AS correct FROM d UNION ALL SELECT id, id, true FROM r WHERE n >= 4)
 SELECT id, choice, correct, CAST(row_number() OVER (PARTITION BY id ORDER BY md5('2:' || id || ':' || choice), choice) AS INT) AS place FROM b"""
)
def br_quiz(spark, sf_dir):
    return B.quiz(items(spark, sf_dir))


@query("SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('view', 'click') AND user_id % 4 > 0")
def ac_event_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    agreed = events.select("user_id").filter(F.col("user_id") % 4 > 0)
    return A.consented(events, agreed, ["view", "click"]).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {ACTIVITY}, l AS (SELECT user_id, trim(' term ' || (k % 9) || ' ') AS query, max(ts) AS last_ts FROM activity GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, query) AS rank FROM l) SELECT user_id, query, last_ts, CAST(rank AS INT) AS rank FROM r WHERE rank <= 6")
def ac_search_history(spark, sf_dir):
    searches = activity(spark, sf_dir).select("user_id", "ts", F.concat(F.lit(" term "), F.col("k") % 9, F.lit(" ")).alias("query"))
    return A.search_history(searches)


def updates(spark, sf_dir) -> DataFrame:
    a = activity(spark, sf_dir)
    return a.select("user_id", "article_id", "ts", "event_id", F.when(F.col("k") % 3 > 0, F.concat(F.lit("s"), F.col("k") % 7)).alias("section"), F.when(F.col("k") % 5 > 0, F.col("percent")).alias("percent"), F.when(F.col("event_type") == "purchase", 1).alias("asked"))


_UPDATES = f"{ACTIVITY}, updates AS (SELECT user_id, article_id, ts, event_id, CASE WHEN k % 3 > 0 THEN 's' || (k % 7) END AS section, CASE WHEN k % 5 > 0 THEN percent END AS percent, CASE WHEN event_type = 'purchase' THEN 1 END AS asked FROM activity)"
_MERGED = "SELECT user_id, article_id, arg_max(section, (ts, event_id)) FILTER (section IS NOT NULL) AS section, arg_max(percent, (ts, event_id)) FILTER (percent IS NOT NULL) AS percent, CAST(sum(coalesce(asked, 0)) AS BIGINT) AS asked, max(ts) AS updated_at FROM updates GROUP BY ALL"


@query(f"WITH {_UPDATES} {_MERGED}")
def ac_progress_merge(spark, sf_dir):
    return A.merge_progress(updates(spark, sf_dir))


@query(
    f"""WITH {_UPDATES}, m AS ({_MERGED}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, article_id DESC) AS r FROM m) WHERE r = 1)
 SELECT l.user_id, l.article_id, CASE WHEN d.doc_id IS NOT NULL THEN d.source ELSE l.article_id END AS title, CAST(round(greatest(0, least(1, coalesce(l.percent, 0))) * 100) AS INT) AS percent FROM l LEFT JOIN documents d ON 'article-' || d.doc_id = l.article_id"""
)
def ac_continue(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("article-"), "doc_id").alias("id"), F.col("source").alias("title"))
    return A.continue_reading(A.merge_progress(updates(spark, sf_dir)), named)


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM d),
 r AS (SELECT user_id, island, count(*) AS n, max(day) AS last_day FROM i GROUP BY ALL) SELECT user_id, arg_max(n, last_day) AS "count", CAST(max(last_day) AS VARCHAR) AS last_day FROM r GROUP BY user_id"""
)
def ac_streak(spark, sf_dir):
    return A.streaks(table(spark, sf_dir, "events")).withColumn("last_day", F.col("last_day").cast("string"))


@query(
    f"""WITH {ACTIVITY}, t AS (SELECT *, CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'clear' ELSE 'toggle' END AS action FROM activity), c AS (SELECT user_id, max((ts, event_id)) AS cleared FROM t WHERE action = 'clear' GROUP BY user_id)
 SELECT t.user_id, t.article_id FROM t LEFT JOIN c USING (user_id) WHERE action = 'toggle' AND (cleared IS NULL OR (ts, event_id) > cleared) GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def ac_bookmarks(spark, sf_dir):
    clear = (F.col("event_type") == "error") & (F.col("k") % 10 == 0)
    return A.bookmarks(activity(spark, sf_dir).withColumn("action", F.when(clear, F.lit("clear")).otherwise(F.lit("toggle"))))


_TURNS = "t AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS answer FROM conversations)"


@query(
    f"""WITH {_TURNS}, s AS (SELECT conv_id % 10 AS user_id, trim(text) AS question, CAST(conv_id % 50 AS VARCHAR) AS source_id, trim(answer) AS answer, conv_id * 100 + turn AS saved_at FROM t WHERE role = 'user' AND next_role = 'assistant' AND trim(answer) <> ''),
 c AS (SELECT user_id, question, source_id, answer, saved_at, 0 AS gone FROM s UNION ALL SELECT user_id, question, source_id, answer, saved_at + 250, 1 FROM s WHERE saved_at % 7 = 0), w AS (SELECT conv_id % 10 AS user_id, max(conv_id * 100) AS cleared FROM conversations WHERE conv_id % 23 = 0 GROUP BY 1),
 l AS (SELECT *, row_number() OVER (PARTITION BY user_id, question, source_id, answer ORDER BY saved_at DESC, gone DESC) AS r FROM c)
 SELECT l.user_id, sha256(question || '|' || source_id || '|' || answer) AS id, question, source_id, answer, saved_at FROM l LEFT JOIN w USING (user_id) WHERE r = 1 AND gone = 0 AND (cleared IS NULL OR saved_at > cleared)"""
)
def ac_saved_qa(spark, sf_dir):
    """Answers of ten users: every seventh is removed a little later, and some conversations begin by clearing all."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    said = table(spark, sf_dir, "conversations")
    turns = said.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    user, at = (F.col("conv_id") % 10).alias("user_id"), F.col("conv_id") * 100 + F.col("turn")
    saves = turns.filter("role = 'user' AND next_role = 'assistant'").select(user, F.lit("save").alias("action"), F.col("text").alias("question"), (F.col("conv_id") % 50).cast("string").alias("source_id"), "answer", at.alias("saved_at"))
    removes = saves.filter("saved_at % 7 = 0").withColumn("action", F.lit("remove")).withColumn("saved_at", F.col("saved_at") + 250)
    clears = said.filter("conv_id % 23 = 0").select(user, F.lit("clear").alias("action"), (F.col("conv_id") * 100).alias("saved_at")).distinct()
    return A.saved_answers(saves.unionByName(removes).unionByName(clears, allowMissingColumns=True))


@query(
    """WITH n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT user_id, event_id % n.n AS vec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS c FROM events, n),
 w AS (SELECT user_id, vec_id, pow(0.85, back) * CASE WHEN back = c - 1 THEN 1.0 ELSE 0.15 END AS w FROM r), p AS (SELECT w.user_id, w.w, unnest(e.embedding) AS x, unnest(range(0, 64)) AS dim FROM w JOIN embeddings e USING (vec_id))
 SELECT user_id, CAST(dim AS INT) AS dim, round(sum(w * x), 6) AS value FROM p GROUP BY user_id, dim"""
)
def ac_profile_ema(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = vectors.count()
    reads = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % n).alias("id"), "ts", "event_id")
    return A.profiles(reads, vectors).withColumn("value", F.round("value", 6))


@query(f"WITH {ACTIVITY}, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM activity) SELECT event_id, user_id, ts FROM n WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600000000")
def ac_debounce(spark, sf_dir):
    return A.debounce(activity(spark, sf_dir), 3_600_000).select("event_id", "user_id", "ts")


@query(
    f"""WITH RECURSIVE {ACTIVITY}, o AS MATERIALIZED (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, article_id ORDER BY ts, event_id) AS rn FROM activity),
 w AS (SELECT user_id, article_id, ts, event_id, percent, rn, true AS taken, ms AS lm, percent AS lp FROM o WHERE rn = 1 UNION ALL
  SELECT user_id, article_id, ts, event_id, percent, rn, taken, CASE WHEN taken THEN ms ELSE lm END, CASE WHEN taken THEN percent ELSE lp END FROM (SELECT o.*, w.lm, w.lp, abs(o.percent - w.lp) >= 0.25 OR o.ms - w.lm >= 36000000 AS taken FROM w JOIN o ON o.user_id = w.user_id AND o.article_id = w.article_id AND o.rn = w.rn + 1)),
 k AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, article_id ORDER BY ts, event_id) AS nx FROM w WHERE taken)
 SELECT user_id, article_id, ts, event_id, percent, nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 1000000 AS written FROM k"""
)
def ac_throttle(spark, sf_dir):
    return A.throttle(activity(spark, sf_dir), 0.25, 36_000_000, 1000)


@query(
    """SELECT 'tumbling' AS kind, time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS n FROM events GROUP BY ALL
 UNION ALL SELECT 'sliding', s, s + INTERVAL '2 hours', event_type, count(*) FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY ALL"""
)
def ac_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    one = A.windowed_counts(events, "1 hour").withColumn("kind", F.lit("tumbling"))
    return one.unionByName(A.windowed_counts(events, "2 hours", "1 hour").withColumn("kind", F.lit("sliding"))).select("kind", "start", "end", "event_type", "n")


@query(
    """WITH n AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM n)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, sid"""
)
def ac_sessions(spark, sf_dir):
    return A.sessions(table(spark, sf_dir, "events"), "6 hours")


@query("SELECT count(*) AS n FROM events")
def ac_event_count(spark, sf_dir):
    return A.event_count(table(spark, sf_dir, "events"))


def _scratch(spark: SparkSession) -> str:
    """A new folder in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(ORACLES["ac_windows"].split("UNION ALL")[0].replace("'tumbling' AS kind, ", ""))
def ac_windows_stream(spark, sf_dir):
    """The tumbling windows by a stream that runs over the whole table once. Append mode would hold back the windows that the
    last watermark has not passed, so the sink keeps the latest count of every window."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _scratch(spark)
    events.write.parquet(f"{folder}/in")
    counts = A.windowed_counts(S.read_events(spark, f"{folder}/in", events.schema), "1 hour", late="40 days")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("start", "end", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


def _run_through(spark, name: str, rows: DataFrame, after: str, run, slices: int = 3) -> DataFrame:
    """The whole table as a log that grows in the order of time, by some slices and a closing event; the stream goes on from its
    checkpoint after each."""
    folder = f"{_scratch(spark)}-{name}"
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [i / slices for i in range(1, slices)]).alias("c")).first()["c"] or []
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.unix_micros("ts") > c, 1).otherwise(0)
    parts = [rows.filter(F.coalesce(number, F.lit(0)) == i) for i in range(len(cuts) + 1)]
    for part in [*parts, S.closing(rows, after)]:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = run(S.read_events(spark, f"{folder}/in", rows.schema, 1000)).writeStream.format("parquet").option("path", f"{folder}/out")
        stream.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(ORACLES["ac_debounce"])
def ac_debounce_stream(spark, sf_dir):
    rows = activity(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = _run_through(spark, "debounce", rows, "3 DAYS", lambda s: S.debounced(s, 3_600_000, "1 day"))
    return out.filter("user_id IS NOT NULL").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(ORACLES["ac_throttle"])
def ac_throttle_stream(spark, sf_dir):
    rows = activity(spark, sf_dir).select("user_id", "article_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "percent")
    before = {k: spark.conf.get(k) for k in S.STATE_STORE}
    try:
        for k, v in S.STATE_STORE.items():
            spark.conf.set(k, v)
        out = _run_through(spark, "throttle", rows, "3 DAYS", lambda s: S.throttled(s, 0.25, 36_000_000, 1000, "1 day"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return out.filter("user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {_UPDATES} SELECT user_id, article_id, arg_max(percent, (ts, event_id)) FILTER (percent IS NOT NULL) AS percent, max(ts) AS updated_at FROM updates GROUP BY ALL")
def ac_progress_stream(spark, sf_dir):
    rows = updates(spark, sf_dir).select("user_id", "article_id", "ts", "event_id", "percent")
    folder = _scratch(spark)
    rows.repartition(12).write.parquet(f"{folder}/in")  # several files, in no order of time, so that several batches come
    S.upsert_progress(S.read_events(spark, f"{folder}/in", rows.schema, 4), f"{folder}/out", f"{folder}/state").awaitTermination()
    return S.merged_progress(spark, f"{folder}/out")
