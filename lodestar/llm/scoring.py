"""What the two text classifiers share: folds, bounded samples of labelled rows, scoring of feature rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, in_slices


def fold(folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; a null doc_id is in no fold (null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


Extract = Callable[[bytes], list[float]]


def features_of(documents: DataFrame, extract: Extract, width: int, *more: str) -> DataFrame:
    """A row for each row of documents: doc_id, features (array of float), and further columns."""

    def run(batches):
        for batch in batches:
            rows = [np.asarray(extract(t), np.float32) for t in binaries(batch.column(1))]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32), pa.float32())
            ends = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
            arrays = [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(ends, flat), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "features", *more])

    wanted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    schema = wanted.selectExpr("doc_id", "cast(null AS array<float>) AS features", *more).schema
    return wanted.mapInArrow(in_slices(run, 1), schema)


def chosen_labels(labels: DataFrame, label: str, where: Column, rows: int) -> DataFrame:
    """doc_id, y of at most ``rows`` labelled documents: those of the smallest hashes of doc_id. Of several labels for one
    the largest counts."""
    y = labels.where(F.col(label).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    )
    return y.groupBy("doc_id").agg(F.max("y").alias("y")).where(where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(documents: DataFrame, extract: Extract, width: int, chosen: DataFrame, rows: int) -> tuple:
    """Features and labels of the documents in ``chosen`` (doc_id, y; bounded, so it may be broadcast), at most ``rows``, as
    arrays. Only their texts are looked at; no text is shuffled."""
    name = "label_y" if "y" in documents.columns else "y"
    wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = wanted.join(F.broadcast(chosen.withColumnRenamed("y", name)), "doc_id")
    found = features_of(found, extract, width, name).orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(rows)
    got = found.select("features", name).toArrow()
    x = np.asarray(got.column(0).combine_chunks().flatten(), np.float32).reshape(-1, width)
    return x, np.asarray(got.column(1), np.float64)


Score = Callable[[np.ndarray], np.ndarray]


def _scores(texts: list[bytes], extract: Extract, width: int, score: Score) -> np.ndarray:
    x = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        x[i] = extract(t)
    return np.clip(score(x), 0, 1) if len(x) else np.zeros(0)


def scored(documents: DataFrame, extract: Extract, width: int, score: Score, folds: int, out: int, least: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents, in one pass over the texts."""

    def run(batches):
        for batch in batches:
            s = _scores(binaries(batch.column(1)), extract, width, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    wanted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return wanted.mapInArrow(in_slices(run, 1), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(folds) == out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def passing(documents: DataFrame, extract: Extract, width: int, score: Score, least: float) -> DataFrame:
    """The rows of documents whose texts score ``least`` or more, columns as they came: one pass, no shuffle."""
    at = len(documents.columns)

    def run(batches):
        for batch in batches:
            good = _scores(binaries(batch.column(at)), extract, width, score) >= least
            yield pa.RecordBatch.from_arrays(batch.columns[:at], batch.schema.names[:at]).filter(pa.array(good))

    text = F.col("text").cast("string").alias("scored_text")
    return documents.select("*", text).mapInArrow(in_slices(run, at), documents.schema)
