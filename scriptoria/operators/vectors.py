"""Vectors as array<double> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(x: pa.Array) -> np.ndarray | None:
    """The rows as a matrix, or None if they aren't of one width without nulls."""
    if x.null_count or not len(x):
        return None
    at = np.diff(x.offsets.to_numpy())
    flat = x.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) if at.min() == at.max() and at[0] and not flat.null_count else None


def matrix(c: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one width, without nulls, as a matrix."""
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in c.chunks]).reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def _dots(a: pa.Array, b: pa.Array) -> pa.Array:
    p, q = _matrix(a), _matrix(b)
    if p is not None and q is not None and p.shape == q.shape:
        return pa.array(np.einsum("ij,ij->i", p, q))
    one = lambda x, y: None if x is None or y is None or len(x) != len(y) or None in x or None in y else float(np.dot(x, y))
    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def dot(a: Column, b: Column) -> Column:
    """The dot product, an Arrow batch at a time; null if either is null, holds a null, or lengths differ.

    Higher-order functions on arrays aren't compiled: they take about ten times as long.
    """
    return F.arrow_udf(_dots, "double")(a, b)


def _units(width: int):
    def run(x: pa.Array) -> pa.Array:
        at = x.offsets.to_numpy()
        good = (np.diff(at) == width) & x.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(good)
        flat = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        m = flat[at[rows][:, None] + np.arange(width)]
        fine = np.isfinite(m).all(1) & m.any(1)
        rows, m = rows[fine], m[fine]
        m /= np.abs(m).max(1, keepdims=True) if len(m) else 1
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        size = np.zeros(len(x), np.int32)
        size[rows] = width
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()), mask=pa.array(size == 0))

    return run


def unit(x: Column, width: int) -> Column:
    """The vector scaled to length 1 in double precision; null if it is of another width, all zero, or holds a null or NaN."""
    return F.arrow_udf(_units(width), "array<double>")(x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null if either vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sums(df: DataFrame, group: list[str], vec: str = "vec") -> DataFrame:
    """(group, dim, total, n): the summed vector of each group, added up before the shuffle."""
    return df.select(*group, F.posexplode(vec).alias("dim", "x")).groupBy(*group, "dim").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def mean_cross_cosine(a: DataFrame, b: DataFrame, vec: str = "vec", by: list[str] | None = None) -> DataFrame:
    """(by, n_a, n_b, mean_cos): mean of all unit-vector dot products of a x b, pairs of a row with itself included.

    By the centroid identity the sum over all pairs is one product of summed vectors: linear in the rows. An empty side
    gives no row.
    """
    by = by or []
    x, y = sums(a, by, vec).withColumnsRenamed({"total": "s", "n": "n_a"}), sums(b, [], vec).withColumnsRenamed({"total": "t", "n": "n_b"})
    return x.join(y, "dim").groupBy(*by, "n_a", "n_b").agg((F.sum(F.col("s") * F.col("t")) / (F.max("n_a") * F.max("n_b"))).alias("mean_cos"))
