"""The corpus pipeline: stages over documents, each one's result written as Parquet and read again for the next.

Quality first, as it needs no other document; then near-duplicates, so that repeats are looked for in what stays; then
passages of the benchmark; tokens last. Stages see all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontaminate, minhash, quality, suffix_dedup
from lodestar.llm.common import fresh, small_batches, table, written
from lodestar.llm.entries import RANKS

#: Pieces of text that a worker keeps the ids of: half the usual, as its executor has the heap of the stages before.
PIECES = 1 << 18


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least doc_id stays."""
    small_batches(spark)
    return minhash.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 200-byte strings that are there again go; n_chars follows the text."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, each row by its own text."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; a text that they don't decode to is an error. ``ids`` and ``n_tokens`` of the input, if there
    are such columns, are replaced."""
    small_batches(spark)
    ids, decoded = fresh(docs, "ids"), fresh(docs, "decoded")
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids, decoded, PIECES)
    same = F.col(decoded) == F.coalesce("text", F.lit(""))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("decoding differs in document"), F.col("doc_id")))
    checked = F.when(same, F.col(ids)).otherwise(wrong.cast("array<int>"))
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    return out.withColumn(ids, checked).select(*kept, F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n_tokens"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", remove_repeats),
    ("decontaminate", decontaminate_docs),
    ("tokens", tokenize),
]

#: Trained models and signatures can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. A stage's result is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
