"""The corpus pipeline: each stage keeps what its operator keeps and hands on documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import bpe, jaccard, language, mixing, repeats
from quadrat.runtime import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; rejected ones go."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Near copies have five-word shingles of a Jaccard similarity of 0.8 or more. They are found
    by SimHashes that differ by 12 of 64 bits or fewer, each pair verified on the shingles; those
    whose SimHashes differ by more, as some do at that similarity, by the shingles themselves.
    """
    return jaccard.jaccard_dedup(docs, width=5, radius=12)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a document with a smaller doc_id has."""
    return repeats.remove_repeats(docs, width=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", near_dedup),
    ("repeat_removal", cut_repeats),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: SimHash, radix-sorted repeats and BPE are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
