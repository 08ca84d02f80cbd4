"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import bpe, centroids, fingerprints, html_extract, licenses, mixing, near_dup, prefix_trie, quality, secret_scan, suffix_dedup, token_counts, toxicity

#: Vocabulary files; a cluster sets the folder that all its machines have.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", os.path.dirname(public_tokenizers.path("x")))


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source's documents lie in a folder a language, and there in folders of a hundred."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    docs = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "lang", hundred, F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.scan(docs, keep=("doc_id",))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(mixing.mix(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def spans_text(spans) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *map(n, secret_scan.BASE), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, *toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES = {f.__name__: f for f in (op1_near_dup, op2_licenses, op3_token_counts, op4_mixing, op5_quality, op6_suffix_dedup, op7_main_text, op8_byte_bpe, op9_secrets, op10_fingerprints, op11_prefix_trie, op12_toxicity, op13_clusters)}
