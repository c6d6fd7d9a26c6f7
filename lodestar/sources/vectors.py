"""Vector sources and sinks: Parquet tables, .npy arrays, synthetic data."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VECTORS = "vec_id long, embedding array<float>"
#: Rows of a .npy file that a task reads.
NPY_ROWS = 50_000


def read_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """vec_id, embedding and further columns. With ``dim``, a vector of another length is an error; nulls are dropped."""
    rows = spark.read.parquet(path).where("embedding is not null")
    if dim is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} coordinates in row "), F.col("vec_id").cast("string")))
    fits = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return rows.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(wrong.cast("array<float>")))


def as_queries(vectors: DataFrame) -> DataFrame:
    """query_id, q from vec_id, embedding."""
    return vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))


def first_rows(vectors: DataFrame, n: int) -> DataFrame:
    """The n rows of the least ids."""
    return vectors.orderBy("vec_id").limit(n)


def _npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(f)
    if len(shape) != 2 or by_column or kind.hasobject:
        raise ValueError("a .npy file must hold one matrix of numbers, row by row")
    return shape, kind, f.tell()


class _NpyRows(InputPartition):
    def __init__(self, path: str, first_id: int, row: int, n: int):
        self.path, self.first_id, self.row, self.n = path, first_id, row, n


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", NPY_ROWS))

    def partitions(self) -> list[InputPartition]:
        files, root = pafs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        infos = [found] if found.is_file else files.get_file_info(pafs.FileSelector(root))
        out, at = [], 0
        for path in sorted(i.path for i in infos if i.path.endswith(".npy")):
            with files.open_input_file(path) as f:
                n = _npy_header(f)[0][0]
            out += [_NpyRows(path, at, row, min(self.rows, n - row)) for row in range(0, n, self.rows)]
            at += n
        return out or [_NpyRows("", 0, 0, 0)]

    def read(self, part: _NpyRows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        files, _ = pafs.FileSystem.from_uri(self.path)
        with files.open_input_file(part.path) as f:
            (_, dim), kind, begin = _npy_header(f)
            f.seek(begin + part.row * dim * kind.itemsize)
            for at in range(0, part.n, 10_000):
                n = min(10_000, part.n - at)
                x = np.frombuffer(f.read(n * dim * kind.itemsize), kind).reshape(n, dim).astype(np.float32)
                ends = pa.array(np.arange(n + 1) * dim, pa.int32())
                ids = pa.array(np.arange(n) + part.first_id + part.row + at)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["vec_id", "embedding"])


class NpySource(DataSource):
    """Format ``npy``: vectors of .npy files of any size."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, rows: int = NPY_ROWS) -> DataFrame:
    """Vectors of a .npy file, or of those in a folder (a matrix each, of any size). Rows are numbered through the files in
    the order of their paths. A task seeks to its ``rows`` rows and reads only these."""
    spark.dataSource.register(NpySource)
    uri = path if "://" in path else "file://" + os.path.abspath(path)
    return spark.read.format("npy").option("rows", rows).load(uri)


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Random unit vectors. A row depends on its id and the seed only, however the rows are dealt."""
    block = 1024

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                ids = np.arange(b * block, min(n, (b + 1) * block))
                x = np.random.default_rng([seed, b]).standard_normal((len(ids), dim))
                x = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)
                ends = pa.array(np.arange(len(ids) + 1) * dim, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["vec_id", "embedding"])

    blocks = spark.range(0, -(-n // block), 1, partitions or spark.sparkContext.defaultParallelism)
    return blocks.mapInArrow(run, VECTORS)


def in_ranges(vectors: DataFrame, ranges: list[tuple[int, int]], last: int = 0) -> DataFrame:
    """Rows whose vec_id lies in one of the half-open ranges, and the ``last`` rows (ids number the rows from 0): a training
    set by position."""
    inside = F.lit(False)
    for begin, end in ranges:
        inside = inside | ((F.col("vec_id") >= begin) & (F.col("vec_id") < end))
    if last:
        inside = inside | (F.col("vec_id") >= vectors.count() - last)
    return vectors.where(inside)
