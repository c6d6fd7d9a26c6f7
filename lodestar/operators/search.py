"""Top-k search: exact, over compressed codes, and over product codes.

Queries go to the tasks as arrays, in blocks of bounded size; slices of rows meet a block in one matrix product, and a
task keeps the k best of all its rows for each query. What is left is ranked by a window, whose group limits work before
and after the shuffle by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import linalg
from lodestar.operators.model import Model, byte_rows, matrix

#: Queries held by the tasks at once. More of them make more passes over the vectors.
QUERY_BLOCK = 4096
#: Scores that a task holds at once.
SCORES = 1 << 21
_FOUND = "query_id long, vec_id long, score double"


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries(query_id, q), fetched block by block."""
    rows = queries.where("q is not null").select(F.col("query_id").cast("long"), "q")
    n = rows.count()
    parts = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    for k in range(parts if n else 0):
        got = (rows.where(part == k) if parts > 1 else rows).toArrow().combine_chunks()
        if got.num_rows:
            width = len(got.column(1)[0])
            yield got.column(0).to_numpy(), matrix(got.column(1).combine_chunks(), width).astype(np.float64)


class Best:
    """The k best rows so far for each of some queries; ties by vec_id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.least = np.full(len(query_ids), -np.inf)  #: what a row must score to be among a query's k best
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, columns: np.ndarray | None = None) -> None:
        """Rows with a score for each of the queries, or for those in ``columns``."""
        columns = np.arange(len(self.query_ids)) if columns is None else columns
        least, n = self.least[columns], len(ids)
        if n > self.k and np.isinf(least).any():
            least = self.least[columns] = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k])
        rows, found = np.nonzero(scores >= least)
        self.parts.append((columns[found], scores[rows, found], ids[rows]))
        self.held += len(rows)
        if self.held > SCORES:
            self._cut()

    def _cut(self) -> None:
        columns, scores, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, columns))
        columns, scores, ids = columns[order], scores[order], ids[order]
        rank = np.arange(len(columns)) - np.searchsorted(columns, columns)
        last = rank == self.k - 1
        self.least[columns[last]] = scores[last]
        top = rank < self.k
        self.parts, self.held = [(columns[top], scores[top], ids[top])], int(top.sum())

    def batch(self) -> pa.RecordBatch:
        if self.parts:
            self._cut()
        columns, scores, ids = self.parts[0] if self.parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))
        arrays = [pa.array(self.query_ids[columns], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])


def row_slices(batches, queries: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows times queries stay bounded."""
    step = max(1, SCORES // max(1, queries))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rk (from 1), vec_id, score of the k best; ties by vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rk", F.row_number().over(order))
        .where(F.col("rk") <= k)
        .select("query_id", F.col("rk").cast("long").alias("rk"), "vec_id", "score")
    )


#: Scores of a batch of rows (a row for each) against query vectors (a column for each).
Kernel = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def by_block(rows: DataFrame, queries: DataFrame, run_of: Callable, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score: a pass over the rows for each block of queries; ``run_of`` (ids, vectors) makes the task."""
    found = None
    for query_ids, q in query_blocks(queries, block):
        part = rows.mapInArrow(run_of(query_ids, q), _FOUND)
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], _FOUND) if found is None else found


def topk(
    rows: DataFrame, queries: DataFrame, k: int, kernel: Kernel, prepare: Callable = lambda q: q, block: int = QUERY_BLOCK
) -> DataFrame:
    """The k best rows (vec_id first) for each query. ``prepare`` turns a block of queries into what the kernel wants."""
    if k < 1:
        raise ValueError("k must be positive")

    def run_of(query_ids: np.ndarray, q: np.ndarray):
        q = prepare(q)

        def run(batches):
            best = Best(query_ids, k)
            for batch in row_slices(batches, len(query_ids)):
                best.add(batch.column(0).to_numpy(), kernel(batch, q))
            yield best.batch()

        return run

    return ranked(by_block(rows, queries, run_of, block), k)


def scan(
    rows: DataFrame, queries: DataFrame, kernel: Kernel, prepare: Callable = lambda q: q, block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, vec_id, score of every row (vec_id first) with each query."""

    def run_of(query_ids: np.ndarray, q: np.ndarray):
        q = prepare(q)

        def run(batches):
            for batch in row_slices(batches, 8 * len(query_ids)):
                ids, n = batch.column(0).to_numpy(), len(query_ids)
                arrays = [pa.array(np.tile(query_ids, len(ids))), pa.array(np.repeat(ids, n)), pa.array(kernel(batch, q).ravel())]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

        return run

    return by_block(rows, queries, run_of, block)


def dense(vectors: DataFrame) -> DataFrame:
    return vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")


def inner_product(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    return matrix(batch.column(1), q.shape[1]).astype(np.float64) @ q.T


def cosine(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    x = matrix(batch.column(1), q.shape[1]).astype(np.float64)
    return x @ q.T / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1), 1e-12)


def squared_l2(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    x = matrix(batch.column(1), q.shape[1]).astype(np.float64)
    return np.stack([((x - one) ** 2).sum(1) for one in q], 1)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of vectors(vec_id, embedding) with the largest inner product (or cosine) with each query(query_id, q)."""
    kernels = {"ip": inner_product, "cosine": cosine}
    if metric not in kernels:
        raise ValueError(metric)
    return topk(dense(vectors), queries, k, kernels[metric], block=block)


CODE_COLUMNS = ("vec_id", "sq_codes", "qjl_signs", "norm", "res_norm")


def code_kernel(model: Model) -> Kernel:
    return lambda batch, q: model.scores(q, *code_arrays(batch, model, 1))


def code_topk(codes: DataFrame, queries: DataFrame, model: Model, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The same over codes(vec_id, sq_codes, qjl_signs, norm, res_norm) by approximate inner product."""
    return topk(codes.select(*CODE_COLUMNS), queries, k, code_kernel(model), model.rotate, block)


def rescored(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of found(query_id, vec_id) by exact inner product: their vectors are joined, no others move."""
    rows = found.select("query_id", "vec_id").join(dense(vectors), "vec_id")
    q = queries.where("q is not null").select(F.col("query_id").cast("long").alias("query_id"), "q")
    exact = linalg.dot(F.col("q"), F.col("embedding")).alias("score")
    return ranked(rows.join(q, "query_id").select("query_id", "vec_id", exact), k)


def code_arrays(batch: pa.RecordBatch, model: Model, at: int) -> tuple:
    """Packed codes, packed signs, norms and residual norms from four columns."""
    width = -(-model.dim // (8 // model.sb))
    return (
        byte_rows(batch.column(at), width),
        byte_rows(batch.column(at + 1), model.dim // 8),
        batch.column(at + 2).to_numpy().astype(np.float64),
        batch.column(at + 3).to_numpy().astype(np.float64),
    )
