"""Streams whose state stays small, texts that are blank or odd, exports, and joins that stay small on disk."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mavuno.functions import text as T
from mavuno.operators import activity, browse, quality, search, structure
from mavuno.sources import packs
from mavuno.streaming import activity as streams


def test_the_throttled_stream_forgets_users(spark, tmp_path):
    rng, t0 = random.Random(7), dt.datetime(2024, 1, 1)
    rows = [(u, None if u % 50 == 0 else f"a{u % 3}", t0 + dt.timedelta(milliseconds=rng.randrange(4000)), 10 * u + i, None if i == 3 else rng.random()) for u in range(1000) for i in range(4)]
    rows += [(None, "a", t0, None, 0.1), (None, "a", t0 + dt.timedelta(milliseconds=1), 99, 0.5)]
    df = spark.createDataFrame(rows, "user_id long, article_id string, ts timestamp, event_id long, percent double")
    before = {k: spark.conf.get(k) for k in streams.STATE_STORE}
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for part in (df.filter("ts < '2024-01-01 00:00:02'"), df.filter("ts >= '2024-01-01 00:00:02'"), streams.closing(df, "1 DAY")):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = streams.throttled(streams.read_events(spark, str(tmp_path / "in"), df.schema)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "article_id", "ts", "event_id", "percent", "written")
    want = activity.throttle(df).select(got.columns)
    more, less = got.exceptAll(want), want.exceptAll(got)
    assert (more.count(), less.count()) == (0, 0), (more.take(3), less.take(3))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 50  # of 1,001 users and articles


def test_titles_of_frequent_words_alone_make_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    titles = [" ".join(rng.sample([f"w{i}" for i in range(12)], rng.randrange(1, 10))) for _ in range(150)]
    rows = [(f"{'ab'[i % 2]}-{i}", rng.choice(titles)) for i in range(400)] + [("c-1", "lone"), ("c-2", None)]
    sent, meet = [], search.meet
    monkeypatch.setattr(search, "TITLE_BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_PARTS", 3)
    monkeypatch.setattr(search, "meet", lambda left, right, *rest: sent.append(left.count() + right.count()) or meet(left, right, *rest))
    words = {i: set((t or "").split()) for i, t in rows}
    want = set()
    for i, _ in rows:
        scored = sorted((-(len(words[i] & words[j]) + 2 * (i[0] == j[0])), t is not None, t or "", j) for j, t in rows if j != i)
        want |= {(i, n, x[3], -x[0]) for n, x in enumerate(scored[:3], 1) if x[0]}
    df = spark.createDataFrame(rows, "id string, title string")
    assert {tuple(r) for r in search.related(df, hot=10, most=4).collect()} == want
    assert sent[0] <= 4 * len(rows)  # each title once as a query and once for each of three blocks of queries, where pairs are 161,202


def test_bullets_keep_what_a_line_ends_with(spark):
    text = "• call 555-0\n- ends in 1\n– and 22 \n- tab\t\u00a0"
    got = spark.createDataFrame([(text,)], "t string").select(T.bullet_items("t").alias("b"), T.dash_bullets("t").alias("d")).first()
    assert got["b"] == ["call 555-0", "ends in 1", "and 22", "tab\t"]
    assert got["d"] == "- call 555-0\n- ends in 1\n– and 22\n- tab\t"


def test_letters_that_upper_case_makes_longer_are_no_letters(spark):
    titles = ["ßheit", "ﬁn", "ŉa", "éa", "apple", "İb", "ia", "ic", "\u00a0 Zinc", "ΑΣ", "ΑΣΑ", None]
    rows = [(f"herb-{i}", t) for i, t in enumerate(titles)]
    got = {r["title"]: (r["letter"], r["place"]) for r in browse.az_groups(spark.createDataFrame(rows, "id string, title string")).collect()}
    assert got["apple"] == ("A", 1) and got["\u00a0 Zinc"] == ("Z", 1)
    assert [got[t] for t in ("ia", "ic")] == [("I", 1), ("I", 2)]
    others = sorted((x[1], t) for t, x in got.items() if x[0] == "#")
    assert [t for _, t in others] == ["İb", "ßheit", "éa", "ŉa", "ΑΣ", "ΑΣΑ", "ﬁn", None]


def test_sections_without_text_are_no_sections(spark):
    rows = [(1, ""), (2, None), (3, "Causes:\n \nSIGNS:"), (4, "a\u0001b\nCauses:\nc\u0002d"), (5, "x:\u2028\n Risk  Factors : \ny")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {(r["id"], r["title"], r["body"], r["slug"]) for r in df.select("id", F.inline(structure.toc("t"))).collect()}
    assert got == {(4, "Overview", "a\u0001b", "overview"), (4, "Causes", "c\u0002d", "causes"), (5, "Overview", "x:", "overview"), (5, "Risk Factors", "y", "risk-factors")}


def test_profiles_are_summed_in_cells(spark, monkeypatch):
    rng = random.Random(9)
    vectors = {f"v{i}": [rng.random() for _ in range(5)] for i in range(40)}
    reads = [(u, f"v{rng.randrange(42)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(99)), 100 * u + i) for u in range(30) for i in range(u)]
    sent, meet = [], activity.meet
    monkeypatch.setattr(activity, "meet", lambda left, right, *rest: sent.append((left.count(), right.count())) or meet(left, right, *rest))
    df = spark.createDataFrame(reads, "user_id long, id string, ts timestamp, event_id long")
    index = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>")
    for sizes in ({}, {"read_block": 100, "vector_block": 15}):
        got = {r["user_id"]: r["embedding"] for r in activity.profile_vectors(df, index, **sizes).collect()}
        for u in range(30):
            own, want = sorted((r for r in reads if r[0] == u), key=lambda r: r[2:]), [0.0] * 5
            for n, r in enumerate(own):
                w = 0.85 ** (len(own) - 1 - n) * (0.15 if n else 1)
                want = [a + w * b for a, b in zip(want, vectors.get(r[1], [0.0] * 5), strict=True)]
            assert u not in got and not any(want) or all(abs(a - b) < 1e-6 for a, b in zip(got[u], want, strict=True))
    assert sent == [(40, len(reads)), (40 * 5, len(reads))]  # a row for each read and for each copy of a vector, none for a number in it


def test_texts_are_cut_into_fields_once(spark):
    rows = [("herb", "A", s, n, t) for s, n, t in [("b", 2, "Uses\n" + "x" * 90), ("b", 1, "Uses\n" + "y" * 90), (None, 0, "Uses\n" + "z" * 90), (None, 3, "Notes\n" + "n" * 90), ("c", 4, ""), ("c", 5, None)]]
    pages = spark.createDataFrame(rows, "type string, title string, source string, page_no long, text string")
    chunks = structure.facet_chunks(pages.select("type", "title", "source", "page_no", structure.split_subsections("text").alias("fields")))
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)^\\s*(SYMPTOMS") == 3  # where a line is found to be a label, and twice where the label is read
    got = {(r["chunk_id"], r["source"], r["content_en"][0]) for r in structure.filter_dedupe(chunks, "chunk_id", "content_en", ["source", "page_no"]).collect()}
    assert got == {("herb:A#uses", "b", "y"), ("herb:A#notes", None, "n")}  # a null source comes last


def test_the_corpus_export_keeps_blanks_and_tells_empty_from_null(spark, tmp_path):
    rows = [("1", " a ", "\n x \t\n"), ("2", "", ""), ("3", None, None), ("4", '"q', 'x",\n"'), ("5", "a\\", '\\"'), ("6", "#", "\t")]
    packs.export_corpus_csv(spark.createDataFrame(rows, "id string, title string, content_en string"), str(tmp_path / "out"))
    back = spark.read.options(**packs.CORPUS_STYLE).schema("id string, title string, contentEn string").csv(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_items_without_text_get_an_empty_translation(spark):
    rows = [("herb-1", None, None), ("herb-2", " ", "\n"), ("herb-3", None, " t "), ("herb-4", " e", " ")]
    df = spark.createDataFrame([(i, e, s, "x.jpg") for i, e, s in rows], "id string, content_en string, content_sw string, image string")
    got = {r["id"]: (r["content_sw"], r["missing_fields"]) for r in quality.autofill(df).collect()}
    assert got == {"herb-1": ("", ["too_short"]), "herb-2": ("", ["too_short"]), "herb-3": ("t", ["too_short"]), "herb-4": ("e", ["translation", "too_short"])}
