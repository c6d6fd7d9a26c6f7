"""Encoding vectors to codes, as one Arrow pass or as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import codebook, linalg
from lodestar.operators.model import Model, binary_column, list_column, matrix

CODES = "vec_id long, sq_codes binary, qjl_signs binary, norm double, res_norm double"


def encode(vectors: DataFrame, model: Model) -> DataFrame:
    """Codes of vectors(vec_id, embedding). Row by row, so it runs on streams too. Null embeddings are dropped; a zero
    vector gets norm 0, and with it score 0."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sq, signs, norms, rest = model.encode(matrix(batch.column(1), model.dim))
                columns = [batch.column(0), binary_column(sq), binary_column(signs), pa.array(norms), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "sq_codes", "qjl_signs", "norm", "res_norm"])

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, CODES)


def times_matrix(df: DataFrame, key: str, values: str, by: np.ndarray, name: str = "y") -> DataFrame:
    """key and the products of a vector column with a matrix, as one matrix product a batch. Nulls are dropped."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), by.shape[0]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(x @ by)], [key, name])

    rows = df.where(F.col(values).isNotNull()).select(F.col(key).cast("long").alias(key), values)
    return rows.mapInArrow(run, f"{key} long, {name} array<double>")


def rotated(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, norm, y: the rotated unit vectors."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), model.dim).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))
            y = (x / np.maximum(norms, 1e-12)[:, None]) @ model.rotation
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms), list_column(y)], ["vec_id", "norm", "y"])

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "vec_id long, norm double, y array<double>")


def encoded(vectors: DataFrame, model: Model) -> DataFrame:
    """The steps of the encoding in columns: vec_id, norm, y, codes, about (decoded), rest (residual), res_norm."""
    df = rotated(vectors, model).withColumn("codes", codebook.encoded(F.col("y"), model.book))
    df = df.withColumn("about", codebook.decoded(F.col("codes"), model.book))
    df = df.withColumn("rest", F.zip_with("y", "about", lambda a, b: a - b))
    return df.withColumn("res_norm", linalg.norm(F.col("rest")))

