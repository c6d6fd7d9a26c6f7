"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, decontaminate, media, minhash, oracle, quality, shard, substring_dedup, suffix_dedup, toxicity, url_filter
from lodestar.llm.common import table

#: The vocabulary of the encoding query and of the pipeline.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pictures that a task draws and describes.
PICTURES = 1000


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: an edited copy of each picture whose id is divisible by 20. Index: every picture. Drawing is slow, and a file
    may be one task, so tasks get PICTURES rows each."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    dealt = rows.repartition(1 + n // PICTURES, "vec_id")
    asked = rows.where("vec_id % 20 = 0").repartition(1 + n // 20 // PICTURES, "vec_id")
    return media.by_query(media.find_copies(media.pictures(asked, copies=True), media.pictures(dealt)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express. The others are held against brute force or libraries in the tests."""
    return {
        "op1_minhash": oracle.NEAR_DUPLICATES,
        "op2_substring_dedup": oracle.SUBSTRING_DEDUP,
        "op3_decontaminate": oracle.DECONTAMINATE,
        "op8_suffix_dedup": oracle.SUFFIX_DEDUP,
    }
