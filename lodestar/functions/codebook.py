"""Scalar codebooks for the coordinates of rotated unit vectors, bit packing, and their Column forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.linalg import let

#: Positive centroids for unit variance by bits of the scalar quantizer. Fixed values.
POSITIVE = {1: (0.79788456,), 3: (0.245, 0.756, 1.344, 2.152)}
#: Correction of the residual signs, times 1/sqrt(dim), by bits. Fixed values; None: sqrt(2/pi).
SIGN_SCALE = {1: 0.585, 3: None}


def sq_bits(bits: int) -> int:
    """Bits of the scalar quantizer when one more goes to the residual's sign."""
    if bits not in (2, 4):
        raise ValueError(f"bits must be 2 or 4, not {bits}")
    return bits - 1


def centroids(dim: int, sb: int) -> list[float]:
    if sb not in POSITIVE:
        raise ValueError(f"no codebook of {sb} bits")
    half = [c / math.sqrt(dim) for c in POSITIVE[sb]]
    return [-c for c in reversed(half)] + half


def boundaries(book: list[float]) -> list[float]:
    """Inner boundaries: midpoints of neighbours."""
    return [(a + b) / 2 for a, b in zip(book, book[1:], strict=False)]


def sign_scale(dim: int, sb: int) -> float:
    return (SIGN_SCALE[sb] or math.sqrt(2 / math.pi)) / math.sqrt(dim)


def per_byte(sb: int) -> int:
    """Codes in a byte: as many as fit whole; two of three bits leave the top bits unused."""
    return 8 // sb


# --- numpy

def pack(codes: np.ndarray, sb: int) -> np.ndarray:
    """Rows of codes to rows of bytes, low bits first."""
    n = per_byte(sb)
    wide = np.pad(codes.astype(np.uint8), ((0, 0), (0, -codes.shape[1] % n))).reshape(len(codes), -1, n)
    return np.bitwise_or.reduce(wide << (np.arange(n, dtype=np.uint8) * sb), axis=2)


def unpack(packed: np.ndarray, sb: int, dim: int) -> np.ndarray:
    n = per_byte(sb)
    wide = (packed[:, :, None] >> (np.arange(n, dtype=np.uint8) * sb)) & ((1 << sb) - 1)
    return wide.reshape(len(packed), -1)[:, :dim]


# --- Column expressions

def encoded(y: Column, book: list[float]) -> Column:
    """The code of each coordinate: how many inner boundaries lie strictly below it."""
    cuts = boundaries(book)

    def code(v: Column) -> Column:
        found = F.lit(0)
        for cut in cuts:
            found = found + (v > F.lit(cut)).cast("int")
        return found

    return F.transform(y, code)


def decoded(codes: Column, book: list[float]) -> Column:
    values = F.array(*map(F.lit, book))
    return F.transform(codes, lambda c: F.element_at(values, c + 1))


def packed(codes: Column, sb: int, dim: int) -> Column:
    """Bytes as an array of int, low bits first."""
    n = per_byte(sb)

    def byte(once: Column, b: Column) -> Column:
        found = F.lit(0)
        for i in range(n):
            code = F.coalesce(F.get(once, b * n + i), F.lit(0))
            found = found + F.shiftleft(code, i * sb)
        return found

    every = F.sequence(F.lit(0), F.lit((dim + n - 1) // n - 1))
    return let(codes, lambda once: F.transform(every, lambda b: byte(once, b)))


def unpacked(data: Column, sb: int, dim: int) -> Column:
    n, mask = per_byte(sb), (1 << sb) - 1

    def code(once: Column, j: Column) -> Column:
        byte = F.get(once, F.floor(j / n).cast("int"))
        shift = (j % n) * sb
        return F.floor(byte / F.pow(F.lit(2.0), shift)).cast("int").bitwiseAND(F.lit(mask))

    return let(data, lambda once: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: code(once, j)))


def signs(residual: Column) -> Column:
    """1 for a residual above zero, else 0."""
    return F.transform(residual, lambda r: (r > 0).cast("int"))
