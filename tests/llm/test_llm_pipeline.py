"""The pipeline stage by stage, each against plain Python on what the stage was given."""

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from mavuno.llm import bpe

from .test_llm_near import naive
from .test_llm_native import base_spans

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "byte-level BPE"]
    given = rows(docs)
    good = P.keep_good(spark, docs, SF).cache()
    assert good.columns == COLUMNS and 0.5 < good.count() / len(given) < 1
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [labels[k] == (k in rows(good)) for k in given if k in labels]
    assert sum(right) / len(right) > 0.9

    one = P.keep_one_of_each(spark, good, SF).cache()
    heads = {c for _, _, c, _ in naive([(k, r["text"]) for k, r in rows(good).items()])}
    assert one.columns == COLUMNS and set(rows(one)) == heads

    clean = P.redact_secrets(spark, one, SF).cache()
    before, after = rows(one), rows(clean)
    assert clean.columns == COLUMNS and set(before) == set(after)
    for k, r in before.items():
        assert not base_spans(after[k]["text"]) and after[k]["n_chars"] == len(after[k]["text"])
        assert base_spans(r["text"]) or "[SECRET]" in after[k]["text"] or after[k]["text"] == r["text"]

    mixed = P.mix_sources(spark, clean, SF).cache()
    assert mixed.columns == COLUMNS and 0 < mixed.count() <= clean.count()

    encoding = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.vocabulary(P.RANKS, P.PATTERN).tokens) if t}, special_tokens={})
    last = rows(P.encode_bytes(spark, mixed, SF))
    for k, r in rows(mixed).items():
        assert list(last[k]["ids"]) == encoding.encode_ordinary(r["text"]) and last[k]["round_trip"]


def test_run_equals_its_stages(spark):
    got = rows(P.run(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert set(got) == set(rows(docs)) and all(r["round_trip"] for r in got.values())


def test_repeated_and_missing_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, "en", "s", 3), (1, text, "en", "s", 3), (None, text, "en", "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0) for r in P.keep_one_of_each(spark, df, SF).collect()) == [0, 1, 2]
    assert P.redact_secrets(spark, df, SF).count() == 4
    other = spark.createDataFrame([(1, text, "en", "s", 3), (1, "quite another text of more than five words", "en", "s", 3)], df.schema)
    assert P.keep_one_of_each(spark, other, SF).count() == 2  # different texts under one id
    clash = df.withColumn("base", F.lit("own")).withColumn("spans", F.lit("own")).withColumn("p", F.lit("own")).withColumn("_score", F.lit("own"))
    for stage in (P.redact_secrets, P.mix_sources):
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and {r["base"] + r["spans"] + r["p"] for r in out.collect()} <= {"ownownown"}
    empty = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
