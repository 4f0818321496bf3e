import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mavuno.operators import activity as A
from mavuno.operators import browse as B
from mavuno.operators import quality as Q
from mavuno.operators import search as K
from mavuno.operators import translate as R
from mavuno.operators import vectors as V
from mavuno.streaming import activity as S

ITEM = "id string, title string, content_en string, content_sw string, image string, source_file string"


def test_faults_and_gaps(spark):
    df = spark.createDataFrame([("herb-a", "", None, "", None, "x.json"), ("Bad Id", "T", "usage treatment cause symptom", None, "i.jpg", "x.json")], ITEM)
    errors = {(r["id"], r["error"]) for r in Q.item_errors(df).collect()}
    assert errors == {("herb-a", "missing title"), ("herb-a", "no content"), ("Bad Id", "malformed id")}
    gaps = {r["id"]: r["missing"] for r in Q.content_gaps(df).collect()}
    assert gaps == {"herb-a": "title;content;image;section:treatment;section:causes;section:symptoms;section:usage;section:habitat"}


def test_autofill_marks_what_it_did(spark):
    df = spark.createDataFrame([("herb-a", "A", "short", None, None, "x.json")], ITEM)
    row = Q.autofill(df).first()
    assert (row["image"], row["content_sw"], row["missing_fields"], row["needs_review"]) == ("images/fallback-herb.jpg", "short", ["translation", "too_short"], True)


def test_duplicate_ids_span_files(spark):
    df = spark.createDataFrame([("a", "2.json", "en"), ("a", "1.json", "sw"), ("b", "1.json", "en")], "id string, source_file string, lang string")
    assert [tuple(r) for r in Q.duplicate_ids(df).collect()] == [("a", 2, "1.json")]
    assert Q.duplicate_ids(df, by=("lang",)).count() == 0


def test_search_scores_and_ties(spark):
    items = spark.createDataFrame([("herb-1", "Ginger", "warm root", None), ("herb-2", "Mint", "ginger beside", None), ("herb-3", "Ginger", "warm root", None)], "id string, title string, content_en string, content_sw string")
    queries = spark.createDataFrame([(1, "ginger warm")], "query_id long, query string")
    synonyms = spark.createDataFrame([("warm", "root")], "term string, alt string")
    got = [(r["rank"], r["id"], r["score"]) for r in K.fast_search(items, queries, synonyms).orderBy("rank").collect()]
    assert got == [(1, "herb-1", 4.5), (2, "herb-3", 4.5), (3, "herb-2", 1.0)]


def test_related_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    words = "red blue mint root leaf salt".split()
    rows = [(f"{rng.choice(['herb', 'disease'])}-{i}", " ".join(rng.choice(words, 2)) + f" n{i % 4}") for i in range(40)]
    got = {(r["id"], r["rank"]): r["other"] for r in K.related(spark.createDataFrame(rows, "id string, title string")).collect()}
    for a, t in rows:
        score = lambda o, u: 2 * (o.split("-")[0] == a.split("-")[0]) + len(set(t.split()) & set(u.split()))  # noqa: B023, E731
        best = sorted(((-score(o, u), u, o) for o, u in rows if o != a and score(o, u) > 0))[:3]
        assert [got.get((a, i + 1)) for i in range(len(best))] == [o for *_, o in best]


def test_top_k_ties_and_norms(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[1, 0], [1, 0], [0, 1], [2, 0]])]
    index = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["id"] for r in V.top_k(index, queries, 3).orderBy("rank").collect()] == [3, 0, 1]
    # the 1e-9 beside the norms weighs less for longer vectors
    assert [r["id"] for r in V.top_k(index, queries, 3, "cosine").orderBy("rank").collect()] == [3, 0, 1]
    assert abs(np.linalg.norm(V.code_point_vectors(["some text"])[0]) - 1) < 1e-6


def test_protect_and_segments_give_texts_back(spark):
    texts = ["Vitamin C and vitamin c. Next one! Last?", "plain", "", "[[T0]] odd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:3])], "k long, t string")
    back = R.protect(df, "t", ["vitamin c", "and"]).select("k", R.restore("protected", "marks").alias("t"))
    assert {r["k"]: r["t"] for r in back.collect()} == dict(enumerate(texts[:3]))
    packs = R.sentence_packs(df, "k", "t", 20)
    joined = {r["k"]: r["segment"] for r in R.stitch(packs, "k", "segment", paragraph="paragraph").collect()}
    assert joined == {0: texts[0], 1: "plain"}


def test_failed_batches_keep_their_source(spark):
    def broken(texts):
        raise RuntimeError

    df = spark.createDataFrame([("a",)], "t string")
    assert R.translate(df, "t", broken).first()["translated"] == "a"


def test_line_memory_leaves_marks_alone(spark):
    df = spark.createDataFrame([(1, "Line\n\n- \nLine\n3.")], "k long, t string")
    assert R.line_memory(df, "k", "t", lambda xs: [x.upper() for x in xs]).first()["translated"] == "LINE\n\n- \nLINE\n3."


def test_file_keys(spark):
    names = ["diseases_digestive.cleaned_translation", "diseases-digestive_translation_sw"]
    got = {r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(R.file_key(F.col("s"))).collect()}
    assert got == {"diseases_digestive"}


def test_streaks_and_profiles(spark):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    events = spark.createDataFrame([(1, day(1)), (1, day(2)), (1, day(2)), (1, day(4)), (1, day(5)), (1, day(6))], "user_id long, ts timestamp")
    row = A.streaks(events).first()
    assert (row["count"], row["last_day"]) == (3, dt.date(2024, 1, 6))
    reads = spark.createDataFrame([(1, 1, day(1), 1), (1, 2, day(2), 2), (1, 1, day(3), 3)], "user_id long, id long, ts timestamp, event_id long")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id long, embedding array<double>")
    assert abs(A.profiles(reads, vectors).first()["value"] - (0.85 * (0.85 * 1 + 0.15 * 3) + 0.15)) < 1e-12


def positions():
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 100, 300, 400, 2000, 2100]
    percent = [0.0, 0.02, 0.06, 0.08, 0.09, 0.2]
    return [(1, "a", t0 + dt.timedelta(milliseconds=m), i, p) for i, (m, p) in enumerate(zip(at, percent, strict=True))]


def test_throttle(spark):
    df = spark.createDataFrame(positions(), "user_id long, article_id string, ts timestamp, event_id long, percent double")
    got = [(r["event_id"], r["written"]) for r in A.throttle(df).orderBy("ts").collect()]
    assert got == [(0, True), (2, True), (4, False), (5, True)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    df = spark.createDataFrame(positions(), "user_id long, article_id string, ts timestamp, event_id long, percent double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    S.closing(df, "1 DAY").write.mode("append").parquet(str(tmp_path / "in"))
    for k, v in S.STATE_STORE.items():
        spark.conf.set(k, v)
    stream = S.throttled(S.read_events(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    for k in S.STATE_STORE:
        spark.conf.unset(k)
    got = [(r["ts"], r["written"]) for r in spark.table("throttled").filter("user_id IS NOT NULL").orderBy("ts").collect()]
    assert got == [(r["ts"], r["written"]) for r in A.throttle(df).orderBy("ts").collect()]


def test_debounced_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(milliseconds=m), i, q) for i, (m, q) in enumerate([(0, "g"), (100, "gi"), (220, "gin"), (900, "mint"), (9_000_000, "end")])]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, query string")
    assert [r["query"] for r in A.debounce(df).orderBy("ts").collect()] == ["gin", "mint", "end"]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = S.debounced(S.read_events(spark, str(tmp_path / "in"), df.schema))
    q = out.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["query"] for r in spark.table("debounced").orderBy("ts").collect()] == ["gin", "mint"]


def test_quiz_has_one_right_choice(spark):
    items = spark.createDataFrame([(f"herb-{i}", f"T{i}") for i in range(9)], "id string, title string")
    got = B.quiz(items).toPandas()
    assert (got.groupby("id").size() == 4).all() and (got.groupby("id")["correct"].sum() == 1).all()
    assert (got.groupby("id")["choice"].nunique() == 4).all() and got.equals(pd.DataFrame(B.quiz(items).toPandas()))


def test_whole_texts_are_translated_and_windowed(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "x" * 9001), (3, ""), (4, None)], "k long, t string")
    model = lambda xs: [x.strip().upper() if len(x) <= R.MOST_CHARS else "too long" for x in xs]
    got = {r["k"]: r["translated"] for r in R.translate(df, "t", model).collect()}
    assert got == {1: text.upper(), 2: "X" * 9001, 3: "", 4: ""}
    assert all(p[-1].isspace() for p in R.pieces(text)[:-1]) and len(R.pieces(text)) > 4
    windows = R.word_windows(df, "k", "t").filter("k = 1").orderBy("place").collect()
    assert " ".join(r["segment"] for r in windows) == text and len(windows) == 7


def test_packs_stay_bounded_in_a_larger_table(spark, tmp_path):
    from mavuno.plans import io_queries

    docs = spark.range(120_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source", "9L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = [r["count"] for r in io_queries.P.read_packs(spark, io_queries._pack_folder(spark, str(tmp_path))).groupBy("source_file").count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) <= 1000


def test_progress_keeps_the_last_percent_told_over_several_batches(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batches = [[(1, "a", t(5), 1, 0.5), (1, "a", t(10), 2, None)], [(1, "a", t(7), 3, 0.7), (2, "b", t(1), 4, None)], [(1, "a", t(6), 5, 0.9)]]
    schema = "user_id long, article_id string, ts timestamp, event_id long, percent double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.upsert_progress(S.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["user_id"]: (r["percent"], r["updated_at"]) for r in S.merged_progress(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (0.7, t(10)), 2: (None, t(1))}


def test_failed_translations_are_told(spark):
    def fails(texts):
        raise RuntimeError("no model")

    row = R.translate(spark.createDataFrame([("x",)], "text string"), "text", fails, failed="lost").first()
    assert (row["translated"], row["lost"]) == ("x", True)
    assert R.translate(spark.createDataFrame([("x",)], "text string"), "text", lambda xs: xs, failed="lost").first()["lost"] is False
