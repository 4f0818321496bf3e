"""Grid search, substrings, related titles, hybrid ranking, schemas, memories and streams against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mavuno.operators import activity, browse, json_schema, ordered, quality, search, substrings, translate, vectors
from mavuno.sources import packs
from mavuno.streaming import activity as streams


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_top_k_is_exact_in_a_grid_of_small_blocks(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 6)) * np.exp(rng.normal(0, 2, (700, 1)))
    x[5] = x[6] = x[7]
    x[9] = 0
    y = rng.standard_normal((90, 6))
    y[3] = 0
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    asks = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(y)], "query_id string, embedding array<double>")
    got = {}
    for r in vectors.top_k(index, asks, 4, metric, query_block=30, index_block=25).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    score = y @ x.T
    if metric == "cosine":
        score /= np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-9
    score = score.round(12)
    for i in range(90):
        want = sorted(range(700), key=lambda j: (-score[i, j], j))[:4]
        assert [got[f"q{i}"][n + 1][0] for n in range(4)] == want


def test_bounds_by_length_leave_blocks_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 4)) * np.repeat([100, 1, 0.01], [100, 900, 1000])[:, None]
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((20, 4)))], "query_id long, embedding array<double>")
    sent, meet = [], vectors.meet
    monkeypatch.setattr(vectors, "meet", lambda left, right, *rest: sent.append((left, right)) or meet(left, right, *rest))
    got = vectors.top_k(index, asks, 3, index_block=60)
    assert got.count() == 60 and all(r["id"] < 100 for r in got.collect())
    assert len(sent) == 2 and sum(right.count() for _, right in sent) < 400  # of 2,000 rows


@pytest.mark.parametrize("few", [50_000, 0])
def test_occurrences_are_those_of_a_plain_search(spark, few):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.randrange(60))), "".join(rng.choice("ab") for _ in range(5))) for i in range(200)] + [(999, None, "ab")]
    terms = ["a", "ab", "aa", "bé", "é a", "", "zz", "aba"]
    df = spark.createDataFrame(texts, "id long, x string, y string")
    got = {(r["id"], r["term"]): (r["nx"], r["ny"]) for r in substrings.occurrences(df, ["x", "y"], spark.createDataFrame([(t,) for t in terms], "term string"), few=few, block=3).collect()}
    want = {(i, t): ((x or "").count(t), y.count(t)) for i, x, y in texts for t in terms if t and (t in (x or "") or t in y)}
    assert got == want


def test_related_titles_equal_all_pairs_and_hot_words_stay_linear(spark):
    rng = random.Random(4)
    hot, rare = [f"hot{i}" for i in range(9)], [f"rare{i}" for i in range(40)]
    rows = [(f"{rng.choice(['herb', 'disease'])}-{i}", " ".join(rng.sample(hot, rng.randrange(0, 8)) + rng.sample(rare, rng.randrange(0, 3)))) for i in range(250)]
    rows += [("x-1", None), ("x-2", ""), ("lone-1", "nothing else")]
    words = {i: set((t or "").split()) for i, t in rows}
    titles = {i: t for i, t in rows}
    want = set()
    for i, _ in rows:
        scored = [(-(len(words[i] & words[j]) + 2 * (i.split("-")[0] == j.split("-")[0])), titles[j] is not None, titles[j] or "", j) for j, _ in rows if j != i]
        for n, (s, _, _, j) in enumerate(sorted(x for x in scored if x[0])[:3], 1):
            want.add((i, n, j, -s))
    df = spark.createDataFrame(rows, "id string, title string")
    for most in (10, 3):
        assert {tuple(r) for r in search.related(df, 3, hot=20, most=most).collect()} == want


def test_hybrid_full_examines_few_pairs(spark):
    rng = np.random.default_rng(5)
    n = 800
    meta = [(f"herb-{i}", f"plain word{i % 97}", f"file{i % 5}", [f"alias{i % 89}"]) for i in range(n)]
    x = rng.standard_normal((n, 8))
    queries = [(q, f"herb word{q} alias{q} disease") for q in range(12)]
    y = rng.standard_normal((12, 8))
    its = spark.createDataFrame([(*m, v.tolist()) for m, v in zip(meta, x, strict=True)], "id string, title string, title_sw string, aliases_sw array<string>, embedding array<double>")
    asks = spark.createDataFrame([(*q, v.tolist()) for q, v in zip(queries, y, strict=True)], "query_id int, query string, embedding array<double>")
    names = its.drop("embedding")
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in vectors.hybrid_full(its, asks, names, 3.0, 5, ahead=6).collect()}
    for q, text in queries:
        t = set(text.split())
        score = []
        for i, (id, title, sw, al) in enumerate(meta):
            lex = (2 * len(t & set(title.split())) + 3 * len(t & {sw}) + 3 * len(t & set(al)) + len(t & set(id.split("-")))) / len(t)
            score.append((-(round(float(y[q] @ x[i]), 12) + 3.0 * lex), id))
        for rank, (s, id) in enumerate(sorted(score)[:5], 1):
            assert got[q, rank] == (id, round(-s, 9))
    near = vectors.top_k(its, asks, 30).select("query_id", "id", "score")
    assert vectors.promising(near, asks, names, 3.0, 5).count() < 0.06 * n * 12  # every item holds a word of every query


def test_schema_errors_tell_types_apart(spark):
    schema = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 4}, "n": {"type": ["integer", "null"], "minimum": 2}, "kind": {"enum": ["a", "b"]}, "list": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}}, "additionalProperties": False}}}}
    values = {1: '{"id": "abc", "n": 2.0, "kind": "a", "list": [{"x": 1.5}], "more": 1}', 2: '{"n": 1, "kind": 3, "list": []}', 3: '{"id": "ABCDE", "n": null, "list": [{"x": "1", "y": 2}, 3]}', 4: "[", 5: None, 6: '"text"', 7: '{"id": null, "n": 1.5}'}
    got = Counter((r["k"], r["path"], r["rule"]) for r in json_schema.schema_errors(spark.createDataFrame(list(values.items()), "k int, json string"), schema).collect())
    want = [(2, "id", "required"), (2, "n", "minimum 2"), (2, "kind", "enum"), (2, "list", "minItems 1"), (3, "id", "pattern ^[a-z]+$"), (3, "id", "maxLength 4"), (3, "list[0].x", "type number"), (3, "list[0].y", "not allowed"), (3, "list[1]", "type object")]
    want += [(4, "", "json"), (5, "", "json"), (6, "", "type object"), (7, "id", "type string"), (7, "n", "type integer|null"), (7, "n", "minimum 2")]
    assert got == Counter(want)
    packed = json_schema.pack_items(spark.createDataFrame([("a", '[{"id":"x"},{"id":1}]'), ("b", '{"items":[{"id":"yy"}]}'), ("c", "3")], "file string, json string"))
    assert {(r["file"], r["place"], r["item"]) for r in packed.collect()} == {("a", 0, '{"id":"x"}'), ("a", 1, '{"id":1}'), ("b", 0, '{"id":"yy"}'), ("c", None, None)}
    real = spark.createDataFrame([(1, '{"id":"abc","title":"ab","tags":"x","needsReview":"no","imageMeta":[]}')], "k int, json string")
    assert {r["path"] for r in json_schema.schema_errors(real, quality.ITEM_SCHEMA).collect()} == {"tags", "needsReview", "imageMeta"}


def test_synonym_files(spark):
    files = [("a", '{"x": ["y"], "z": "y", "w": [1], "e": [], "n": null}'), ("b", "[]"), ("c", "{"), ("d", None)]
    got = {tuple(r) for r in json_schema.synonym_errors(spark.createDataFrame(files, "file string, json string")).collect()}
    assert got == {("a", "z", "not a list"), ("a", "n", "not a list"), ("a", "w", "not texts"), ("b", None, "no object"), ("c", None, "no JSON"), ("d", None, "no JSON")}


def upper(texts):
    return [t.upper() for t in texts]


def fail(texts):
    raise RuntimeError("no model")


def test_a_line_memory_that_lasts(spark, tmp_path):
    texts = [(i, f"common line\n- own {i}\n---\n\n" + "x" * 5000) for i in range(40)]
    df = spark.createDataFrame(texts, "id int, t string")
    path = str(tmp_path / "memory")
    broken = translate.line_memory(df, "id", "t", fail, path)
    assert {r["id"]: r["translated"] for r in broken.collect()} == dict(texts)  # a failed batch is not remembered
    for translator in (upper, fail):  # the second run has nothing to translate
        got = {r["id"]: r["translated"] for r in translate.line_memory(df, "id", "t", translator, path).collect()}
        assert got == {i: t.upper() for i, t in texts}
    assert translate.remembered(spark, path).count() == 42


def test_sections_keep_every_item(spark):
    schema = "id int, content_en string, content_sw string, sections array<struct<title:string,body:string>>, needs_review boolean"
    rows = [(1, "one", None, None, True), (2, "two", "own the", [], True), (3, "three", "old", [("t", "b\nc"), ("", "only"), (None, None)], True), (4, None, None, None, None), (5, "five", None, [(" ", "")], True)]
    got = {r["id"]: (r["content_sw"], r["needs_review"], r["sections_sw"] and len(r["sections_sw"])) for r in translate.translate_sections(spark.createDataFrame(rows, schema), upper, [("the", "ya")]).collect()}
    assert got == {1: ("ONE", False, None), 2: ("own ya", False, None), 3: ("T\n\nB\nC\n\nONLY", False, 3), 4: ("", None, None), 5: ("FIVE", False, 1)}


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4)], "source string, n int")
    got = {(r["source"], r["n"], r["place"], r["all"]) for r in ordered.numbered(df, ["source"], ["n"], "place", "all").collect()}
    assert got == {("a", 1, 1, 2), ("a", 4, 2, 2), (None, 2, 1, 2), (None, 3, 2, 2)}
    assert browse.family_lists(spark.createDataFrame([("a-1", "t"), (None, "u")], "id string, title string")).count() == 2
    at = spark.createDataFrame([(None, "x", "2024-01-01 00:00:00", 1, 0.1), (None, "x", "2024-01-01 00:00:01", 2, 0.11), (7, None, "2024-01-01 00:00:00", 3, 0.5)], "user_id long, article_id string, ts string, event_id long, percent double").withColumn("ts", F.to_timestamp("ts"))
    assert {r["event_id"] for r in activity.throttle(at).collect()} == {1, 3}


def test_tables_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("preserve,en,sw\nyes,Vitamin C,vitamini C\n,malaria,x\nyes,HIV,\n")
    (tmp_path / "b.csv").write_text("\ufeffEN;Preserve;SW\nherb;true;mimea\n", encoding="utf-8")
    kept, mapped = packs.read_glossary(spark, str(tmp_path))
    assert {r["en"] for r in kept.collect()} == {"Vitamin C", "HIV", "herb"}
    assert {tuple(r) for r in mapped.collect()} == {("Vitamin C", "vitamini C"), ("malaria", "x"), ("herb", "mimea")}


def test_saved_answers_are_removed_and_cleared(spark):
    rows = [(1, "save", "q", None, "a ", 1), (1, "save", "q", None, "a", 5), (1, "save", "r", "s", "b", 2), (1, "remove", "r", "s", "b", 3), (1, "save", "r", "s", "b", 4), (1, "save", "t", None, " ", 1)]
    rows += [(2, "save", "q", None, "a", 1), (2, "clear", None, None, None, 2), (2, "save", "z", None, "c", 3), (None, "save", "q", None, "a", 1), (None, "remove", "q", None, "a", 1), (3, "remove", "q", None, "a", 9)]
    df = spark.createDataFrame(rows, "user_id long, action string, question string, source_id string, answer string, saved_at long")
    assert {(r["user_id"], r["question"], r["answer"], r["saved_at"]) for r in activity.saved_answers(df).collect()} == {(1, "q", "a", 5), (1, "r", "b", 4), (2, "z", "c", 3)}


def test_the_progress_store_stays_small(spark, tmp_path):
    schema = "user_id long, article_id string, ts timestamp, event_id long, percent double"
    rng = random.Random(6)
    rows = [(rng.randrange(5), f"a{rng.randrange(4)}", i, rng.choice([None, round(rng.random(), 3)])) for i in range(140)]
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "user_id long, article_id string, event_id long, percent double").select("user_id", "article_id", F.timestamp_seconds("event_id").alias("ts"), "event_id", "percent")
    made.repartition(14).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "out")
    for checkpoint in ("state", "state", "again"):  # the last runs all batches again
        streams.upsert_progress(streams.read_events(spark, str(tmp_path / "in"), schema, 1), store, str(tmp_path / checkpoint), compact=4).awaitTermination()
        assert len(list((tmp_path / "out").iterdir())) <= 4
        got = {(r["user_id"], r["article_id"]): r["percent"] for r in streams.merged_progress(spark, store).collect()}
        want = {}
        for u, a, _, p in sorted(rows, key=lambda r: r[2]):
            want[u, a] = p if p is not None else want.get((u, a))
        assert got == want
