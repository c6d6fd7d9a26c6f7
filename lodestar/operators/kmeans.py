"""Lloyd's k-means on DataFrames.

The centroids are small (k * dim doubles) and live on the driver. A round is one pass over the vectors: every task sums its
rows by nearest centroid, so at most k rows a task are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.model import matrix
from lodestar.sources.scratch import written

#: Rows that centroids are trained on, at most.
SAMPLE_ROWS = 65_536
ITERATIONS = 30
#: A sample of up to so many numbers is trained on in the driver, where a round takes less than a job's overhead.
LOCAL_VALUES = 1 << 23
#: Rows whose distances are held at once.
NEAR_ROWS = 1 << 13


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid by squared distance, the first of equals."""
    squares, out = np.einsum("ij,ij->i", centroids, centroids), np.empty(len(x), np.int64)
    for at in range(0, len(x), NEAR_ROWS):
        out[at : at + NEAR_ROWS] = (squares - 2.0 * (x[at : at + NEAR_ROWS] @ centroids.T)).argmin(1)
    return out


def sample_key(seed: int = 0) -> Column:
    """A multiplicative hash of vec_id."""
    key = (F.col("vec_id").cast("decimal(38,0)") + F.lit(seed)) * 2654435761
    return F.pmod(key, F.lit(1 << 32).cast("decimal(38,0)")).cast("long")


def sample(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A fixed pseudo-random choice of at most ``rows`` rows: those of the least hash of vec_id."""
    return vectors.withColumn("sample_key", sample_key()).orderBy("sample_key", "vec_id").limit(rows)


def start(vectors: DataFrame, k: int, seed: int | None = None) -> np.ndarray:
    """k distinct rows: of the least ids, or of the least hashes if a seed is given. Fewer if there are fewer rows."""
    order = F.col("vec_id") if seed is None else sample_key(seed)
    rows = vectors.where("embedding is not null").orderBy(order, "vec_id").select("embedding").limit(k).collect()
    return np.array([r[0] for r in rows], np.float64)


def summed(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """The sums of the rows of each of k groups."""
    width = x.shape[1]
    cells = (near[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, x.ravel(), k * width).reshape(k, width)


def sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """list_id, n, total (array): rows and coordinate sums by nearest centroid."""
    k, dim = centroids.shape

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.float64)
            near = nearest(x, centroids)
            n += np.bincount(near, minlength=k)
            total += summed(x, near, k)
        rows = np.flatnonzero(n)
        ends = pa.array(np.arange(len(rows) + 1) * dim, pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(total[rows].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n[rows]), lists], ["list_id", "n", "total"])

    parts = vectors.where("embedding is not null").select("embedding").mapInArrow(
        run, "list_id long, n long, total array<double>"
    )
    each = [F.sum(F.get("total", F.lit(i))) for i in range(dim)]
    return parts.groupBy("list_id").agg(F.sum("n").alias("n"), F.array(*each).alias("total"))


def update(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the mean of each centroid's rows; a centroid without rows stays."""
    out = centroids.copy()
    for list_id, n, total in sums(vectors, centroids).collect():  # k rows at most
        out[list_id] = np.asarray(total) / n
    return out


def lloyd(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """One round on rows in memory."""
    near = nearest(x, centroids)
    n = np.bincount(near, minlength=len(centroids))
    total = summed(x, near, len(centroids))
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)


def in_memory(vectors: DataFrame, rows: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """vec_id and embedding of a sample, or of all rows if that is None; None if they are too large for the driver."""
    n, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n or dim * (n if rows is None else min(rows, n)) > LOCAL_VALUES:
        return None
    got = (vectors if rows is None else sample(vectors, rows)).select(F.col("vec_id").cast("long"), "embedding").toArrow().combine_chunks()
    return got.column(0).to_numpy(), matrix(got.column(1).combine_chunks(), dim).astype(np.float64)


def first_of(ids: np.ndarray, x: np.ndarray, k: int, seed: int | None = None) -> np.ndarray:
    """What ``start`` gives, of rows in memory."""
    key = [0 if seed is None else (i + seed) * 2654435761 % (1 << 32) for i in ids.tolist()]
    return x[np.lexsort((ids, key))[:k]].copy()


def train(vectors: DataFrame, k: int, iterations: int = ITERATIONS, rows: int = SAMPLE_ROWS, seed: int | None = 42) -> np.ndarray:
    """Centroids of a bounded sample of vectors(vec_id, embedding) after a fixed number of rounds: in the driver if the
    sample is small, else a pass over its partitions for each round."""
    vectors = vectors.where("embedding is not null").select("vec_id", "embedding")
    if local := in_memory(vectors, rows):
        centroids = first_of(*local, k, seed)
        for _ in range(iterations if len(centroids) else 0):
            centroids = lloyd(local[1], centroids)
        return centroids
    chosen = written(sample(vectors, rows).repartition(max(1, rows // 4096), "vec_id"), "training")
    centroids = start(chosen, k, seed)
    for _ in range(iterations if len(centroids) else 0):
        centroids = update(chosen, centroids)
    return centroids
