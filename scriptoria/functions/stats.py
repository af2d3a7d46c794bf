"""p-values that Spark has no function for. Each runs once per result row, not per input row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tables no likelier than the seen one may be likelier by this share, which is rounding.
SLACK = 1e-7
_PIECE = 4096


def _rest(n: float) -> float:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _off(x: float, mean: float) -> float:
    """x ln(x / mean) - x + mean, without cancellation where x is near mean."""
    d = (x - mean) / (x + mean)
    if abs(d) >= 0.1:
        return x * math.log(x / mean) - x + mean
    total, term, k = (x - mean) * d, 2 * x * d, 1
    while True:
        term *= d * d
        more = total + term / (2 * k + 1)
        if more == total:
            return total
        total, k = more, k + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """ln of the binomial law by deviances, exact to rounding for any n."""
    if x == 0 or x == n:
        other = q if x == 0 else p
        near = n * math.log(other) if other < 0.9 else n * math.log1p(-(p if x == 0 else q))
        return near if n else 0.0
    parts = _rest(n) - _rest(x) - _rest(n - x) - _off(x, n * p) - _off(n - x, n * q)
    return parts + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def log_table(a: int, row: int, col: int, n: int) -> float:
    """ln of the probability of a in the first cell, given the margins."""
    p, q = col / n, (n - col) / n
    return _log_binomial(a, row, p, q) + _log_binomial(col - a, n - row, p, q) - _log_binomial(col, n, p, q)


def _outward(a: int, row: int, col: int, n: int, step: int, end: int) -> float:
    """Sum of the probabilities from a to end, over that of a: ratios of neighbours, until terms vanish."""
    total, last, at = 1.0, 1.0, a
    while at != end:
        k = np.arange(1, min(_PIECE, abs(end - at)) + 1, dtype=np.float64)
        if step > 0:
            below = at + k - 1
            ratio = (row - below) * (col - below) / ((below + 1) * (n - row - col + below + 1))
        else:
            above = at - k + 1
            ratio = above * (n - row - col + above) / ((row - above + 1) * (col - above + 1))
        terms = last * np.cumprod(ratio)
        total += float(terms.sum())
        last, at = float(terms[-1]), at + step * len(k)
        if last < 1e-18 * total and ratio[-1] < 1:
            break
    return total


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p: all tables of these margins that are no likelier than the one seen.

    The law has one peak, so these are the tail from the seen table outward and the tail from its counterpart on the other side,
    which is found by halving. Cost depends on the law's width, not on its support.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    if lo == hi:
        return 1.0
    peak = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))
    seen = log_table(a, row, col, n)
    if seen >= log_table(peak, row, col, n) - SLACK:
        return 1.0
    step, end, other = (-1, lo, hi) if a < peak else (1, hi, lo)
    p = math.exp(seen) * _outward(a, row, col, n, step, end)
    fits = lambda k: log_table(k, row, col, n) <= seen + SLACK
    if fits(other):
        near, far = peak, other  # near is too likely, far is not
        while abs(far - near) > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if fits(mid) else (mid, far)
        p += math.exp(log_table(far, row, col, n)) * _outward(far, row, col, n, -step, other)
    return min(1.0, p)


def _fisher(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
    t = np.stack([pa.compute.fill_null(x, -1).to_numpy(zero_copy_only=False) for x in (a, b, c, d)], axis=1)
    kinds, at = np.unique(t, axis=0, return_inverse=True) if len(t) else (t, np.zeros(0, np.int64))
    p = np.array([np.nan if min(k) < 0 else fisher(*k) for k in kinds.tolist()], np.float64)[at.ravel()]
    return pa.array(p, pa.float64(), mask=np.isnan(p))


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact p of the 2x2 table; null if a cell is null or negative."""
    return F.arrow_udf(_fisher, "double")(*[x.cast("long") for x in (a, b, c, d)])


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of x >= 0: its series of positive terms below 2, its continued fraction from there."""
    x = np.asarray(x, np.float64)
    near = np.minimum(x, 2.0)
    term = total = 2 / math.sqrt(math.pi) * near * np.exp(-near * near)
    for k in range(1, 50):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    far = np.clip(x, 2.0, 40.0)
    below = far.copy()
    for k in range(80, 0, -1):
        below = far + k / 2 / below
    return np.where(x < 2, 1 - total, np.exp(-far * far) / math.sqrt(math.pi) / below)


def _tail(z: pa.Array) -> pa.Array:
    x = z.to_numpy(zero_copy_only=False).astype(np.float64)
    return pa.array(erfc(np.abs(np.nan_to_num(x)) / math.sqrt(2)), pa.float64(), mask=np.isnan(x))


def normal_p(z: Column) -> Column:
    """Two-sided tail of the standard normal law; null of a null."""
    return F.arrow_udf(_tail, "double")(z.cast("double"))


def student(t: float, v: float) -> float:
    """Two-sided tail of Student's law with v degrees of freedom: the incomplete beta function by its continued fraction."""
    x = v / (v + t * t)
    a, b = v / 2, 0.5
    if x >= 1:
        return 1.0
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        a, b, x = b, a, t * t / (v + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, 1 - front * h if turned else front * h)


def _rank_p(rho: pa.Array, n: pa.Array) -> pa.Array:
    def one(r, m):
        if r is None or m is None or m < 3:
            return None
        return 0.0 if abs(r) >= 1 else student(abs(r) * math.sqrt((m - 2) / (1 - r * r)), m - 2)

    return pa.array([one(r, m) for r, m in zip(rho.to_pylist(), n.to_pylist())], pa.float64())


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n cases by Student's law with n - 2 degrees of freedom; null below three cases."""
    return F.arrow_udf(_rank_p, "double")(rho.cast("double"), n.cast("long"))


def log_odds(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log odds ratio of the 2x2 table with half a case added to each cell."""
    return F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
