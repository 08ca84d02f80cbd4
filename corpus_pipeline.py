"""A corpus pipeline of five stages, each over all that its predecessor kept.

Defined cases: rows with a null or empty text fail the quality rules; rows of one id with different texts are judged by their
texts; of rows that are equal in all columns one stays after near-duplicates; further columns stay as they are, whatever their
names; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import bpe, mixing, near_dup, quality, secret_scan
from kelpline.llm.queries import vocabulary
from kelpline.plans.checkpoints import delete_folder, shared_folder


def counted(docs: DataFrame) -> DataFrame:
    """Documents with n_chars of their texts as they are now."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their lines that fail; n_chars is counted anew where that changed it."""
    return counted(quality.keep_good(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    return near_dup.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted anew where that changed it."""
    return counted(secret_scan.mask_secrets(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, whole; where a target ends inside a document, it is
    taken if at least half of its words are.  A document whose source has no room left doesn't come out."""
    return mixing.repeat_whole(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids: doc_id, n_tokens, and the digests of its ids and of the bytes that they decode to."""
    out = bpe.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", tokens_stage),
]

#: SQL can't express the signatures, the splitting tree and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet in the shared folder and read again.  A stage's
    files go when the next one's are written; the last one's stay, as the result reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if i:
            delete_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
