"""Distances between vectors and bounds on them, as SQL expressions and as array kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(column: str | Column) -> Column:
    """An array column as doubles; floats are widened before anything is subtracted."""
    return F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; -1 where the lengths differ, null where a vector is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).when(a.isNotNull() & b.isNotNull(), F.lit(-1.0))


def distances(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """All distances of rows of x to rows of anchors, from differences (no cancellation)."""
    out = np.empty((len(x), len(anchors)))
    for j, a in enumerate(anchors):
        d = x - a
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def within_3pt(d_anchor: Column, d_between: Column, rlim: float) -> Column:
    """Whether the triangle inequality leaves room for a distance of at most rlim."""
    return F.abs(d_between - d_anchor) <= rlim


def bound_4pt(d12: Column, d13: Column, d23: Column, d14: Column, d24: Column) -> Column:
    """Least distance of points 3 and 4, given their distances to points 1 and 2, by planar placement."""
    x3 = (d13 * d13 - d23 * d23 + d12 * d12) / (2 * d12)
    x4 = (d14 * d14 - d24 * d24 + d12 * d12) / (2 * d12)
    y3 = F.sqrt(F.greatest(F.lit(0.0), d13 * d13 - x3 * x3))
    y4 = F.sqrt(F.greatest(F.lit(0.0), d14 * d14 - x4 * x4))
    return F.when(d12 < 1e-9, F.abs(d14 - d13)).otherwise(F.sqrt((x3 - x4) * (x3 - x4) + (y3 - y4) * (y3 - y4)))


def bound_4pt_np(d12, d13, d23, d14, d24):
    """The same on arrays."""
    safe = np.where(d12 < 1e-9, 1.0, d12)
    x3 = (d13**2 - d23**2 + safe**2) / (2 * safe)
    x4 = (d14**2 - d24**2 + safe**2) / (2 * safe)
    y3, y4 = np.sqrt(np.maximum(0, d13**2 - x3**2)), np.sqrt(np.maximum(0, d14**2 - x4**2))
    return np.where(d12 < 1e-9, np.abs(d14 - d13), np.hypot(x3 - x4, y3 - y4))


def bound_5pt_np(d12, d13, d23, d14, d24, d34, d15, d25, d35):
    """Least distance of points 4 and 5 from their distances to points 1, 2, 3, by placement in space.

    0 (no bound) where points 1, 2, 3 are too close to a line.
    """
    d12, d13, d23, d14, d24, d34, d15, d25, d35 = (np.asarray(v, float) for v in (d12, d13, d23, d14, d24, d34, d15, d25, d35))
    e = np.where(d12 < 1e-9, 1.0, d12)
    x3 = (d13**2 - d23**2 + e**2) / (2 * e)
    yy = d13**2 - x3**2
    flat = (d12 < 1e-9) | (yy < 1e-9)
    y3 = np.sqrt(np.where(flat, 1.0, yy))

    def place(d1, d2, d3):
        x = (d1**2 - d2**2 + e**2) / (2 * e)
        y = (d1**2 - d3**2 + x3**2 + y3**2 - 2 * x3 * x) / (2 * y3)
        return x, y, np.sqrt(np.maximum(0, d1**2 - x**2 - y**2))

    (x4, y4, z4), (x5, y5, z5) = place(d14, d24, d34), place(d15, d25, d35)
    return np.where(flat, 0.0, np.sqrt((x4 - x5) ** 2 + (y4 - y5) ** 2 + (z4 - z5) ** 2))


def bound_5pt(d12, d13, d23, d14, d24, d34, d15, d25, d35) -> Column:
    """bound_5pt_np as an expression."""
    x3 = (d13 * d13 - d23 * d23 + d12 * d12) / (2 * d12)
    yy = d13 * d13 - x3 * x3
    y3 = F.sqrt(yy)

    def place(d1, d2, d3):
        x = (d1 * d1 - d2 * d2 + d12 * d12) / (2 * d12)
        y = (d1 * d1 - d3 * d3 + x3 * x3 + yy - 2 * x3 * x) / (2 * y3)
        return x, y, F.sqrt(F.greatest(F.lit(0.0), d1 * d1 - x * x - y * y))

    (x4, y4, z4), (x5, y5, z5) = place(d14, d24, d34), place(d15, d25, d35)
    far = F.sqrt((x4 - x5) * (x4 - x5) + (y4 - y5) * (y4 - y5) + (z4 - z5) * (z4 - z5))
    return F.when((d12 < 1e-9) | (yy < 1e-9), F.lit(0.0)).otherwise(far)


def fmatch(dr: Column, a: float = 2.0, b: float = 0.5) -> Column:
    """Weight of a visitor whose distance differs by dr radii: a at 0, falling to b at 2, 0 beyond."""
    return F.when(dr > 2, F.lit(0.0)).otherwise(F.lit(a) - (F.lit(a) - F.lit(b)) * dr / 2)


def fmatch_np(dr: np.ndarray, a: float = 2.0, b: float = 0.5) -> np.ndarray:
    near = (a - b) * dr
    near /= 2
    return np.where(dr > 2, 0.0, np.subtract(a, near, out=near))


# fixed values: coefficients of the cubic in place of exp(-x) on [0, 2]
_EXP = (0.978371, 0.419481, 0.073231)


def soft_exp(x: Column) -> Column:
    """exp(-x) by a cubic for x <= 2, 0 beyond."""
    c1, c2, c3 = _EXP
    return F.when(x <= 2, 1 - x * (c1 - x * (c2 - c3 * x))).otherwise(F.lit(0.0))


def soft_exp_np(x: np.ndarray) -> np.ndarray:
    c1, c2, c3 = _EXP
    return np.where(x <= 2, 1 - x * (c1 - x * (c2 - c3 * x)), 0.0)


def rough_log2(x: np.ndarray) -> np.ndarray:
    """Exponent plus linear mantissa: exact at powers of two, a little low between."""
    m, e = np.frexp(x)
    return e - 1 + (2 * m - 1)
