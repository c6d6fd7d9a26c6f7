"""The compression model: rotation, scalar codebook and residual signs, with numpy kernels for Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from lodestar.functions import codebook
from lodestar.functions.linalg import rotation


@dataclass
class Model:
    dim: int
    bits: int = 4
    seed: int = 42
    #: Centroids fitted to data instead of the analytic ones.
    book: list[float] = field(default_factory=list)
    scale: float | None = None

    def __post_init__(self):
        self.sb = codebook.sq_bits(self.bits)
        if self.dim <= 0 or self.dim % 8:
            raise ValueError(f"dim must be a positive multiple of 8, not {self.dim}")
        self.book = list(self.book) or codebook.centroids(self.dim, self.sb)
        if len(self.book) != 1 << self.sb:
            raise ValueError(f"{len(self.book)} centroids for {self.sb} bits")
        self.scale = codebook.sign_scale(self.dim, self.sb) if self.scale is None else self.scale
        self.rotation = rotation(self.dim, self.seed)

    def codes(self, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(codebook.boundaries(self.book), y, "left").astype(np.uint8)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, packed signs, norms and residual norms of rows. Rows are rotated at unit length."""
        x = x.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        y = (x / np.maximum(norms, 1e-12)[:, None]) @ self.rotation
        c = self.codes(y)
        rest = y - np.asarray(self.book)[c]
        packed_signs = np.packbits(rest > 0, axis=1, bitorder="little")
        return codebook.pack(c, self.sb), packed_signs, norms, np.sqrt(np.einsum("ij,ij->i", rest, rest))

    def rotate(self, queries: np.ndarray) -> np.ndarray:
        return queries.astype(np.float64) @ self.rotation

    def scores(self, rotated: np.ndarray, packed: np.ndarray, signs: np.ndarray, norms, rest_norms) -> np.ndarray:
        """Approximate inner products with rotated queries: a row for each code, a column for each query."""
        per = codebook.per_byte(self.sb)
        values = np.asarray(self.book)[codebook.unpack(np.arange(256, dtype=np.uint8)[:, None], self.sb, per)]
        ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1.0
        about = values[packed].reshape(len(packed), -1)[:, : self.dim]
        about = about + ones[signs].reshape(len(signs), -1)[:, : self.dim] * (self.scale * rest_norms)[:, None]
        return (about @ rotated.T) * norms[:, None]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix; lists of another length are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors of {dim} coordinates expected")
    return flat.reshape(len(column), dim)


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as a matrix of bytes."""
    if column.null_count or not pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or ends[-1] - ends[0] != len(column) * width:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(column), width)


def binary_column(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as a binary column."""
    rows = np.ascontiguousarray(rows, np.uint8)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def list_column(rows: np.ndarray) -> pa.Array:
    """Rows of numbers of one width as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
