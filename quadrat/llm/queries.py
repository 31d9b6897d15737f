"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import bpe, language, metric_join, mixing, neighbours, quality, repeats, simhash, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), width=3, radius=2)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"), width=50)


def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_neighbours": op3_neighbours,
    "op4_repeats": op4_repeats,
    "op5_metric_join": op5_metric_join,
    "op6_bpe": op6_bpe,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op4_repeats": repeats.SQL,
    "op5_metric_join": metric_join.SQL,
    "op7_mixing": mixing.SQL,
    "op9_warc": warc.SQL,
}
