"""Inverted lists: assignment, sizes, offsets, probes, and search in the probed lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.encode import CODES
from lodestar.operators.kmeans import nearest
from lodestar.operators.model import Model, binary_column, matrix
from lodestar.operators.search import CODE_COLUMNS, QUERY_BLOCK, Best, code_arrays, query_blocks, ranked, row_slices


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, list_id of the nearest centroid by squared distance. No shuffle."""

    def run(batches):
        for batch in batches:
            near = nearest(matrix(batch.column(1), centroids.shape[1]).astype(np.float64), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int64())], ["vec_id", "list_id"])

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "vec_id long, list_id long")


def encode_lists(vectors: DataFrame, centroids: np.ndarray, model: Model) -> DataFrame:
    """Codes with list_id, in one pass."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), model.dim).astype(np.float64)
            sq, signs, norms, rest = model.encode(x)
            near = pa.array(nearest(x, centroids), pa.int64())
            columns = [batch.column(0), binary_column(sq), binary_column(signs), pa.array(norms), pa.array(rest), near]
            names = ["vec_id", "sq_codes", "qjl_signs", "norm", "res_norm", "list_id"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, CODES + ", list_id long")


def sizes(assigned: DataFrame, nlist: int) -> DataFrame:
    """list_id, size; lists without rows have size 0."""
    every = assigned.sparkSession.range(nlist).select(F.col("id").alias("list_id"))
    counted = assigned.groupBy("list_id").agg(F.count("*").alias("size"))
    return every.join(counted, "list_id", "left").select("list_id", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def offsets(listed: DataFrame) -> DataFrame:
    """list_id, size, begin, finish: where each list lies when all are laid end to end. One row for each list."""
    order = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return listed.withColumn("finish", F.sum("size").over(order)).select(
        "list_id", "size", (F.col("finish") - F.col("size")).alias("begin"), "finish"
    )


def probe_arrays(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """The nearest lists of each query in rising distance; ties by list."""
    d = np.einsum("ij,ij->i", centroids, centroids) - 2.0 * (q @ centroids.T)
    return np.argsort(d, axis=1, kind="stable")[:, : min(nprobe, len(centroids))]


def probe(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """query_id, rk, list_id."""

    def run(batches):
        for batch in batches:
            found = probe_arrays(matrix(batch.column(1), centroids.shape[1]).astype(np.float64), centroids, nprobe)
            n, k = found.shape
            ids = np.repeat(batch.column(0).to_numpy(), k)
            columns = [pa.array(ids), pa.array(np.tile(np.arange(1, k + 1), n)), pa.array(found.ravel().astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "rk", "list_id"])

    rows = queries.where("q is not null").select(F.col("query_id").cast("long"), "q")
    return rows.mapInArrow(run, "query_id long, rk long, list_id long")


def search(
    codes: DataFrame, queries: DataFrame, centroids: np.ndarray, model: Model, k: int, nprobe: int, block: int = QUERY_BLOCK
) -> DataFrame:
    """The k best rows of the probed lists for each query. Lists that no query of a block probes are not read, if codes
    are partitioned by list_id."""
    found = None
    every = codes.select(*CODE_COLUMNS, F.col("list_id").cast("long"))
    for query_ids, q in query_blocks(queries, block):
        probes = probe_arrays(q, centroids, nprobe)
        wanted = np.zeros((len(centroids), len(q)), bool)
        wanted[probes.ravel(), np.repeat(np.arange(len(q)), probes.shape[1])] = True
        rotated = model.rotate(q)

        def run(batches, query_ids=query_ids, q=rotated, wanted=wanted):
            best = Best(query_ids, k)
            for batch in row_slices(batches, len(query_ids)):
                ids, lists = batch.column(0).to_numpy(), batch.column(5).to_numpy()
                arrays = code_arrays(batch, model, 1)
                for at in np.unique(lists):
                    rows, asked = np.flatnonzero(lists == at), np.flatnonzero(wanted[at])
                    if len(asked):
                        best.add(ids[rows], model.scores(q[asked], *(a[rows] for a in arrays)), asked)
            yield best.batch()

        lists = np.flatnonzero(wanted.any(1)).tolist()
        rows = every.where(F.col("list_id").isin(lists)) if len(lists) < len(centroids) else every
        part = rows.mapInArrow(run, "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = codes.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return ranked(found, k)
