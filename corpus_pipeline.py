"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing to target weights, SentencePiece.

Each stage takes all that the one before kept and is written as Parquet between two stages, in the
cluster's checkpoint folder when run() does it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import mixing, quality, secrets, sentencepiece_codec, simhash
from veriframe.llm.common import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and compression bands keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked that are no widely copied examples, and n_chars counted anew where they were."""
    return secrets.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix."""
    import public_tokenizers

    done = sentencepiece_codec.coded(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has no zstandard, no XXH64 of this seed and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
