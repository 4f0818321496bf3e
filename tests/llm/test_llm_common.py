"""Joins on hot keys, written tables, ranges."""

import bisect

import pytest
from pyspark.sql import functions as F

from mavuno.llm import common, html_text, near_join
from mavuno.llm.components import connected

from .test_llm_near import corpus, naive


@pytest.mark.parametrize("most", [0, 50_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_joined_serves_hot_keys(spark, monkeypatch, most, how):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    keys = ["hot"] * 3000 + [f"k{i % 700}" for i in range(4000)] + ["lone"] * 5 + [None]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string").repartition(5)
    facts = rows.filter("k is not null and k <> 'lone'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    for spread in (None, F.col("id")):
        out = common.joined(rows, facts, ["k"], "n", how=how, spread=spread)
        assert set(out.columns) == {"id", "k", "n", "last"}
        got = {r["id"]: (r["k"], r["n"], r["last"]) for r in out.collect()}
        last = {k: i for i, k in enumerate(keys)}
        want = {i: (k, keys.count(k), last[k]) for i, k in enumerate(keys[:3000:500] + keys[3000:3010]) for i in [keys.index(k)] if k}
        assert all(got[i] == w for i, w in want.items()) and len(got) == (7006 if how == "left" else 7000)
    plan = out._jdf.queryExecution().toString()
    assert ("_salt" in plan) == (most == 0)


def test_near_copies_and_components_without_small_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    edges = [(7, x) for x in range(200, 900)] + [(899, 5), (1, 2)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 5 for i in (5, 7, *range(200, 900))) and got[2] == 1 and all(got[i] == 1000 for i in range(1000, 1041))
    rows = corpus(5)[:70]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["copy_id"], r["class_id"], r["n_links"]) for r in near_join.near_duplicates(df).collect()) == naive(rows)


def test_pages_of_large_hosts_without_small_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    monkeypatch.setattr(html_text, "PAGES", 4)
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30)]
    rows = [(i, f"http://h{i % 3 // 2}.example/{i}", f"<div>{own[i]}</div><div>this shop is closed on all days of the coming week</div>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == dict(enumerate(own))


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1.0], b"x", ("a", None))], "a long, b array<double>, c binary, d struct<e:string,f:int>")
    assert common.cut(df).dtypes == df.dtypes and common.cut(df).collect() == df.collect()
    assert common.cut(df.limit(0)).dtypes == df.dtypes and common.cut(spark.createDataFrame([], df.schema)).count() == 0


def test_range_numbers_are_those_of_a_binary_search(spark):
    df = spark.createDataFrame([(i * i % 1009 - 300,) for i in range(2000)] + [(None,)], "k long")
    cuts = common.ranges(df, "k", rows_each=7)
    assert len(cuts.cuts) > 100
    for r in df.select("k", cuts.number(F.col("k")).alias("n")).collect():
        assert r["n"] == (None if r["k"] is None else bisect.bisect_right(cuts.cuts, r["k"]))
