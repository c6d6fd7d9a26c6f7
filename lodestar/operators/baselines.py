"""Baselines: global scalar quantization, product quantization, and their grouped scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.linalg import dot, let
from lodestar.operators import kmeans
from lodestar.operators.kmeans import nearest
from lodestar.operators.model import binary_column, byte_rows, list_column, matrix
from lodestar.operators.search import dense, scan, topk
from lodestar.sources.scratch import written


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column whose lists are of one length, as a matrix of doubles."""
    return matrix(column, len(column[0]) if len(column) else 1).astype(np.float64)


def value_range(vectors: DataFrame) -> DataFrame:
    """One row: low and high of all coordinates."""
    return vectors.agg(
        F.min(F.array_min("embedding")).cast("double").alias("low"), F.max(F.array_max("embedding")).cast("double").alias("high")
    )


def sq_codes(v: Column, low: Column, high: Column, bits: int, rounding: bool = False) -> Column:
    """Affine codes of all coordinates; truncated, or rounded if asked."""
    top = (1 << bits) - 1
    step = (high - low) / top

    def code(x: Column) -> Column:
        y = F.when(step > 0, (x.cast("double") - low) / step).otherwise(0.0)
        y = F.floor(y + F.lit(0.5)) if rounding else F.floor(y)
        return F.least(F.greatest(y, F.lit(0)), F.lit(top)).cast("int")

    return F.transform(v, code)


def sq_encode(vectors: DataFrame, bits: int, rounding: bool = False) -> DataFrame:
    """vec_id, codes, low, high: the range is one row, broadcast."""
    both = vectors.where("embedding is not null").crossJoin(F.broadcast(value_range(vectors)))
    return both.select("vec_id", "embedding", sq_codes(F.col("embedding"), F.col("low"), F.col("high"), bits, rounding).alias("codes"), "low", "high")


def sq_decode(codes: Column, low: Column, high: Column, bits: int) -> Column:
    return F.transform(codes, lambda c: low + c * (high - low) / ((1 << bits) - 1))


def pack_high_first(codes: Column, bits: int, dim: int) -> Column:
    """Bytes (array of int), the first code in the highest bits."""
    n = 8 // bits

    def byte(once: Column, b: Column) -> Column:
        found = F.lit(0)
        for i in range(n):
            found = found + F.shiftleft(F.coalesce(F.get(once, b * n + i), F.lit(0)), (n - 1 - i) * bits)
        return found

    every = F.sequence(F.lit(0), F.lit((dim + n - 1) // n - 1))
    return let(codes, lambda once: F.transform(every, lambda b: byte(once, b)))


def unpack_high_first(data: Column, bits: int, dim: int) -> Column:
    n, mask = 8 // bits, (1 << bits) - 1

    def code(once: Column, j: Column) -> Column:
        byte = F.get(once, F.floor(j / n).cast("int"))
        return F.floor(byte / F.pow(F.lit(2.0), (n - 1 - j % n) * bits)).cast("int").bitwiseAND(F.lit(mask))

    return let(data, lambda once: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: code(once, j)))


def sq_score(q: Column, codes: Column, norm: Column) -> Column:
    """Norm times the product of a query with raw integer codes."""
    return dot(q, codes) * norm


# --- stored scalar codes


def sq_table(vectors: DataFrame, bits: int, low: float, high: float) -> DataFrame:
    """vec_id, codes (binary, the first code in the highest bits of a byte), norm: a pass over the vectors."""
    top = (1 << bits) - 1
    step = (high - low) / top
    n = 8 // bits
    shift = (np.arange(n - 1, -1, -1) * bits).astype(np.uint8)

    def run(batches):
        for batch in batches:
            x = vectors_of(batch.column(1))
            c = np.clip(np.floor((x - low) / step) if step > 0 else np.zeros_like(x), 0, top).astype(np.uint8)
            wide = np.pad(c, ((0, 0), (0, -c.shape[1] % n))).reshape(len(c), -1, n)
            packed = np.bitwise_or.reduce(wide << shift, axis=2)
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(packed), pa.array(norms)], ["vec_id", "codes", "norm"])

    return dense(vectors).mapInArrow(run, "vec_id long, codes binary, norm double")


def _sq_values(batch: pa.RecordBatch, dim: int, bits: int) -> np.ndarray:
    """The codes of a batch(vec_id, codes, ...) as numbers."""
    n = 8 // bits
    shift = (np.arange(n - 1, -1, -1) * bits).astype(np.uint8)
    of_byte = ((np.arange(256, dtype=np.uint8)[:, None] >> shift) & ((1 << bits) - 1)).astype(np.float64)
    return of_byte[byte_rows(batch.column(1), -(-dim // n))].reshape(batch.num_rows, -1)[:, :dim]


def sq_scan(table: DataFrame, queries: DataFrame, bits: int) -> DataFrame:
    """query_id, vec_id, score of every stored row: norm times the product of a query with raw integer codes."""

    def kernel(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        return _sq_values(batch, q.shape[1], bits) @ q.T * batch.column(2).to_numpy()[:, None]

    return scan(table, queries, kernel)


def sq_topk(table: DataFrame, queries: DataFrame, bits: int, low: float, high: float, k: int) -> DataFrame:
    """The k best stored rows by inner product with the decoded codes."""

    def kernel(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        return (low + _sq_values(batch, q.shape[1], bits) * ((high - low) / ((1 << bits) - 1))) @ q.T

    return topk(table.select("vec_id", "codes"), queries, k, kernel)


# --- product quantization

def subvector(v: Column, m: int, width: int) -> Column:
    return F.slice(v, m * width + 1, width)


def pq_split(vectors: DataFrame, parts: int, dim: int) -> DataFrame:
    """vec_id, m, sub: the parts of each vector."""
    if dim % parts:
        raise ValueError(f"{dim} coordinates don't split into {parts} parts")
    width = dim // parts
    subs = F.array(*(subvector(F.col("embedding"), m, width) for m in range(parts)))
    rows = vectors.where("embedding is not null").select("vec_id", F.posexplode(subs).alias("m", "sub"))
    return rows.select("vec_id", F.col("m").cast("long").alias("m"), "sub")


def _lloyd_sums(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinate sums by nearest entry of each part: n (parts, k), total (parts, k, width)."""
    parts, k, width = books.shape
    n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width))
    for m in range(parts):
        sub = x[:, m * width : (m + 1) * width]
        near = nearest(sub, books[m])
        n[m] = np.bincount(near, minlength=k)
        total[m] = kmeans.summed(sub, near, k)
    return n, total


def pq_train(
    vectors: DataFrame,
    parts: int,
    dim: int,
    size: int = 256,
    iterations: int = 20,
    seed: int | None = None,
    sample_rows: int | None = kmeans.SAMPLE_ROWS,
) -> np.ndarray:
    """Codebooks (parts, size, dim / parts) by Lloyd rounds, all parts in each pass, on a sample of at most sample_rows rows, or
    on all rows if that is None: in the driver if they are small, else read again for each pass."""
    width = dim // parts
    rows = vectors.where("embedding is not null").select("vec_id", "embedding")
    local = kmeans.in_memory(rows, sample_rows) if iterations or sample_rows is not None else None
    if local:
        first = kmeans.first_of(*local, size, seed)
    else:
        if sample_rows is not None:
            rows = written(kmeans.sample(rows, sample_rows).repartition(max(1, sample_rows // 4096), "vec_id"), "training")
        first = kmeans.start(rows, size, seed)
    books = first.reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(iterations if books.shape[1] else 0):
        if local:
            n, total = _lloyd_sums(local[1], books)
            books = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], books)
            continue

        def run(batches, now=books):
            n, total = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape)
            for batch in batches:
                more = _lloyd_sums(matrix(batch.column(0), dim).astype(np.float64), now)
                n, total = n + more[0], total + more[1]
            m, c = np.nonzero(n)
            columns = [pa.array(m), pa.array(c), pa.array(n[m, c]), list_column(total[m, c])]
            yield pa.RecordBatch.from_arrays(columns, ["m", "c", "n", "total"])

        summed = rows.select("embedding").mapInArrow(run, "m long, c long, n long, total array<double>")
        each = [F.sum(F.get("total", F.lit(i))) for i in range(width)]
        books = books.copy()
        for m, c, n, total in summed.groupBy("m", "c").agg(F.sum("n"), F.array(*each)).collect():
            books[m, c] = np.asarray(total) / n
    return books


def pq_encode(vectors: DataFrame, books: np.ndarray, *more: str) -> DataFrame:
    """vec_id, codes (the nearest entry of each part's codebook), and further columns as they came."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), parts * width).astype(np.float64).reshape(-1, parts, width)
            codes = np.stack([nearest(x[:, m], books[m]) for m in range(parts)], 1).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(codes), *batch.columns[2:]], ["vec_id", "codes", *more])

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding", *more)
    schema = rows.selectExpr("vec_id", "cast(null AS array<smallint>) AS codes", *more).schema
    return rows.mapInArrow(run, schema)


# --- stored product codes


def pq_table(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, codes (binary, a byte for each part): a pass over the vectors. Books of up to 256 entries."""
    parts, size, width = books.shape
    if size > 256:
        raise ValueError(f"{size} entries don't fit a byte")

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), parts * width).astype(np.float64).reshape(-1, parts, width)
            codes = np.stack([nearest(x[:, m], books[m]) for m in range(parts)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(codes)], ["vec_id", "codes"])

    return dense(vectors).mapInArrow(run, "vec_id long, codes binary")


def pq_luts(books: np.ndarray):
    """For queries, their tables: the product of each part with each entry (queries, parts, entries)."""
    parts, _, width = books.shape
    return lambda q: np.einsum("qmd,mkd->qmk", q.reshape(-1, parts, width), books)


def _look_up(batch: pa.RecordBatch, luts: np.ndarray) -> np.ndarray:
    codes = byte_rows(batch.column(1), luts.shape[1])
    out = np.zeros((len(codes), len(luts)))
    for m in range(luts.shape[1]):
        out += luts[:, m].T[codes[:, m]]
    return out


def pq_scan(table: DataFrame, queries: DataFrame, books: np.ndarray) -> DataFrame:
    """query_id, vec_id, score of every stored row: the sum of its table entries."""
    return scan(table, queries, _look_up, pq_luts(books))


def pq_topk(table: DataFrame, queries: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """The k best stored rows by the sum of their table entries."""
    return topk(table, queries, k, _look_up, pq_luts(books))


def pq_decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, embedding: the entries of the codes, joined."""
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            c = matrix(batch.column(1), parts)
            x = books[np.arange(parts), c].reshape(len(c), -1)
            ends = pa.array(np.arange(len(c) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, embedding array<double>")


def pq_tables(queries: DataFrame, books: np.ndarray) -> DataFrame:
    """query_id, lut (array of arrays): the product of each query's parts with each entry."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            q = matrix(batch.column(1), parts * width).astype(np.float64).reshape(-1, parts, width)
            lut = [np.einsum("md,mkd->mk", x, books).tolist() for x in q]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lut, pa.list_(pa.list_(pa.float64())))], ["query_id", "lut"])

    rows = queries.where("q is not null").select(F.col("query_id").cast("long"), "q")
    return rows.mapInArrow(run, "query_id long, lut array<array<double>>")


def pq_score(codes: Column, lut: Column) -> Column:
    """The sum of a row's table entries."""
    picked = F.zip_with(codes, lut, lambda c, t: F.element_at(t, c.cast("int") + 1))
    return F.aggregate(picked, F.lit(0.0), lambda s, v: s + v)
