"""Fitting a scalar codebook to data: one-dimensional Lloyd rounds over rotated coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestar.functions import codebook
from lodestar.operators import kmeans, search
from lodestar.operators.model import Model, matrix

#: Coordinates that the codebook is fitted on, at most.
SAMPLE_VALUES = 1_000_000
ITERATIONS = 50


def coordinates(vectors: DataFrame, model: Model, values: int = SAMPLE_VALUES) -> np.ndarray:
    """Rotated coordinates of unit vectors, of at most values / dim rows: those of the least hash of vec_id. They are few
    enough for the driver."""
    rows = kmeans.sample(search.dense(vectors), max(1, values // model.dim)).select("embedding")
    got = rows.toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0)
    x = matrix(got.column(0).combine_chunks(), model.dim).astype(np.float64)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return (x @ model.rotation).ravel()


def start(values: np.ndarray, k: int) -> list[float]:
    """The middles of k quantile ranges, interpolated."""
    return np.quantile(values, [(i + 0.5) / k for i in range(k)]).tolist() if len(values) else []


def update(values: np.ndarray, book: list[float]) -> list[float]:
    """One round; a centroid without values stays."""
    code = np.searchsorted(codebook.boundaries(book), values, "left")
    n, total = (np.bincount(code, w, len(book)) for w in (None, values))
    return sorted(np.where(n > 0, total / np.maximum(n, 1), book).tolist())


def fit(vectors: DataFrame, model: Model, iterations: int = ITERATIONS, values: int = SAMPLE_VALUES) -> list[float]:
    """A codebook of as many centroids as the model's, until it moves no more."""
    found = coordinates(vectors, model, values)
    book = start(found, 1 << model.sb)
    for _ in range(iterations if book else 0):
        was, book = book, update(found, book)
        if np.allclose(was, book, rtol=1e-5, atol=1e-6):
            break
    return book or list(model.book)
