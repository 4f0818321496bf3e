"""The training-data pipeline: quality, near duplicates, secrets, mixture, tokens. Each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mavuno.llm import bpe, mixing, near_join, quality, secret_scan
from mavuno.llm.common import shared_folder, table
from mavuno.llm.queries import PATTERN, RANKS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for; the voter learns from the whole corpus's labelled training fold.

    Null and empty texts score 0 and go; long texts are read whole; equal texts stay or go together, row by row.
    """
    score = "_score"
    while score in docs.columns:
        score += "_"
    voter = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, voter, into=score).filter(F.col(score) >= quality.LEAST_SCORE).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id.

    Rows of one id and one text become one; different texts under one id, and rows without an id, stay. Texts without words
    are copies of equal texts only.
    """
    heads = near_join.near_duplicates(docs).filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what is found as a secret is replaced by a mark, and n_chars follows. Null and empty texts stay as they are."""
    aside = {c: f"_own_{c}" for c in ("base", "spans") if c in docs.columns}
    clean = secret_scan.redact(secret_scan.scan(docs.withColumnsRenamed(aside)))
    clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return clean.drop("base", "spans").withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of about 0.8 of the tokens that meets the raked shares of source, language and topic, flattened as far as the
    corpus has the tokens. Documents without words are never taken; null sources and languages count as categories."""
    aside = {c: f"_own_{c}" for c in ("topic", "tokens", "p", "kept", "residual") if c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(aside)).filter("kept").drop("topic", "tokens", "p", "kept", "residual")
    return mixed.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back. Null counts as the empty text, without ids."""
    lean = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    ids = bpe.encode(lean, RANKS, PATTERN, decoded="decoded", keep_text=False).withColumn("n_tokens", F.size("ids").cast("long"))
    return ids.withColumn("round_trip", F.sha2("decoded", 256) == F.col("text_sha256")).drop("decoded", "text_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_bytes),
]

#: The classifier and the Bayesian pruning have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to all that the one before kept, through Parquet in the shared folder. The folders
    stay for whoever wants to look at a stage; their owner removes them."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
