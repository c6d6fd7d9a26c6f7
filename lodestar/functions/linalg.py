"""Vector functions as Column expressions. All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once a row even where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v / ‖v‖; a zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix; the same for the same arguments. y = x @ rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)
