"""Array expressions over vectors; for many pairs use the kernels of ``operators.vector_search``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; NULL where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def is_valid(v: Column, dims: Column | int) -> Column:
    """Expected length, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def patches(v: Column, count: int, dims: int) -> Column:
    """A flat vector as ``count`` patches of ``dims``."""
    return F.array(*[F.slice(v, k * dims + 1, dims) for k in range(count)])


def maxsim(query: Column, candidate: Column, top_n: int = 1) -> Column:
    """Mean over query patches of the mean of the ``top_n`` best candidate patches; 0 without patches."""
    if top_n <= 0:
        raise ValueError("top_n must be positive")

    def best(patch: Column) -> Column:
        sims = F.transform(candidate, lambda c: F.aggregate(F.zip_with(patch, c, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v))
        top = F.slice(F.sort_array(sims, asc=False), 1, top_n)
        return F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)

    each = F.transform(query, best)
    return F.when((F.size(query) > 0) & (F.size(candidate) > 0), F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(query)).otherwise(F.lit(0.0))


def shifted(v: Column, direction: Column, strength: float) -> Column:
    """Moved along a direction and brought back to unit length."""
    return l2_normalize(F.zip_with(v, direction, lambda x, d: x.cast("double") + d.cast("double") * F.lit(strength)))


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats as an array; NULL where the length isn't a whole number of them."""
    return blob.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(BinaryType())
def to_bytes(vector: pd.Series) -> pd.Series:
    """An array as little-endian 32-bit floats."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def reshaped(v: Column, dims: int) -> Column:
    """A flat vector as rows of ``dims``; NULL where it doesn't divide."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(v) / dims).cast("int") - 1), lambda k: F.slice(v, k * dims + 1, dims))
    return F.when((F.size(v) > 0) & (F.size(v) % dims == 0), rows)


def point_hash(vectors: list[Column], payload: Column) -> Column:
    """SHA-256 of the vectors' bytes and a payload's text."""
    return F.sha2(F.concat(*vectors, F.encode(payload, "UTF-8")), 256)
