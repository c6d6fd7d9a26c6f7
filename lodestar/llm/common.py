"""What the operators of this package share: reading columns, slices of batches, Arrow helpers."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.scratch import forget, written  # noqa: F401  the operators of this package take them from here


#: Rows that go to Python at once, at most. Rows have whole texts here, so Spark's 10,000 are too many.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session hand rows to Python in batches of BATCH_ROWS at most; for applications, before they use the operators."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (so any file system will do)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Equal for equal texts, and for no others short of a SHA-256 collision; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins and ends among all its values (one more number than rows), and those values. Null
    lists are empty."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]), column.flatten()


#: What a task works on at once: so many rows, and so many bytes of text unless one row has more.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded size; ``text``: the number of the column that has the bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    done = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(done, done[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


def in_slices(run: Callable, text: int) -> Callable:
    """For ``mapInArrow``: ``run`` gets batches cut into slices. When a task ends, its worker, which others reuse, gives the
    memory back that it has freed."""

    def cut(batches):
        for batch in batches:
            yield from slices(batch, text)

    def sliced(batches):
        try:
            yield from run(cut(batches))
        finally:
            give_back()

    return sliced


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def row_keys(doc: Column, text: Column) -> list[Column]:
    """k1, k2: 128 bits that tell rows of different doc or text apart."""
    return [F.xxhash64(doc, text).alias("k1"), F.xxhash64(F.lit("second key"), text, doc).alias("k2")]


def binaries(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Odd multipliers, all arithmetic is modulo 2**64.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand; for hashes of spans by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, by in (("up", self.base), ("down", self.inverse)):
                factors = np.full(n, by, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """S[i] = sum of values[j] * base**j over j < i."""
        self._grown(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end], the same wherever the span lies."""
        self._grown(len(prefix))
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
