"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, bpe, fingerprints, hard_negatives, html_text, language, mixing, near_join, packing, phrases, quality, secret_scan, shards
from .common import held_out, table
from .oracles import ORACLES

#: Target weights of languages; whatever else occurs gets a fiftieth together.
LANGUAGES = {"en": 0.48, "de": 0.17, "es": 0.15, "fr": 0.18, mixing.OTHERS: 0.02}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every text and of its edited text, and their likeness to each other and to the next text's."""
    return fingerprints.chained(table(spark, sf_dir, "documents"))


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voter = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", held_out()), voter)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.LEAST_SCORE).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents: what the three patterns find, and random strings besides."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"),
        secret_scan.listed("spans").alias("spans"),
    )


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near-equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(text))
    dealt = shards.byte_shards(docs, 40, F.octet_length(text) + 16, payload=("text_crc32",))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents, with each one's number of links."""
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language.learn(docs)
    return language.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), network).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the tokens, languages by stated weights, sources and topics by flattened shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, keep=0.5, targets={"lang": LANGUAGES}, keep_text=False)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to every fiftieth one, among all."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the text that they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANKS, PATTERN, decoded="decoded", keep_text=False).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most exclusive phrases of two and three words of each language of all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"), top=2000)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector for its five best positives, among all vectors; every seventh label is moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, each with every source in its share of all tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, VOCABULARY).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_syncmer_fingerprints, op2_quality_votes, op3_secret_scan, op4_byte_shards, op5_near_duplicates, op6_language, op7_mixing, op8_main_text, op9_neighbours, op10_byte_bpe, op11_collocations, op12_hard_negatives, op13_packing)
}

__all__ = ["ORACLES", "QUERIES"]
