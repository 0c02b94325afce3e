"""Polynomials: series as Column recurrences, fits from moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ufuncs import col


def polyval(c: list[float], x) -> Column:
    """Horner's rule, the highest power first."""
    x, out = col(x), F.lit(0.0)
    for a in c:
        out = out * x + float(a)
    return out


def _clenshaw(c: list[float], x: Column, alpha, beta, first) -> Column:
    b1, b2 = F.lit(0.0), F.lit(0.0)
    for k in range(len(c) - 1, 0, -1):
        b1, b2 = float(c[k]) + alpha(k, x) * b1 + beta(k + 1) * b2, b1
    return float(c[0] if c else 0.0) + first(x) * b1 + beta(1) * b2


def chebval(c, x) -> Column:
    return _clenshaw(c, col(x), lambda k, t: 2 * t, lambda k: -1.0, lambda t: t)


def legval(c, x) -> Column:
    return _clenshaw(c, col(x), lambda k, t: (2 * k + 1) / (k + 1) * t, lambda k: -k / (k + 1), lambda t: t)


def hermval(c, x) -> Column:
    return _clenshaw(c, col(x), lambda k, t: 2 * t, lambda k: -2.0 * k, lambda t: 2 * t)


def lagval(c, x) -> Column:
    return _clenshaw(c, col(x), lambda k, t: (2 * k + 1 - t) / (k + 1), lambda k: -k / (k + 1), lambda t: 1 - t)


def polyfit(df: DataFrame, x: str, y: str, degree: int, weight: str | None = None) -> list[float]:
    """Least squares by one aggregate of moments about the mean; the small system is solved on the driver."""
    centre = df.agg(F.avg(x).alias("m"), F.coalesce(F.stddev_pop(x), F.lit(1.0)).alias("s")).head()
    m, s = centre["m"], centre["s"] or 1.0
    t, w = (F.col(x) - m) / s, F.col(weight) * F.col(weight) if weight else F.lit(1.0)
    power = lambda k: F.pow(t, F.lit(float(k))) if k else F.lit(1.0)
    sums = df.agg(*(F.sum(w * power(k)).alias(f"a{k}") for k in range(2 * degree + 1)), *(F.sum(w * power(k) * F.col(y)).alias(f"b{k}") for k in range(degree + 1))).head()
    a = np.array([[sums[f"a{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    c = np.linalg.lstsq(a, np.array([sums[f"b{i}"] for i in range(degree + 1)]), rcond=None)[0]
    out = np.zeros(1)
    for v in c[::-1]:  # back from (x - m) / s
        out = np.polyadd(np.polymul(out, [1 / s, -m / s]), [v])
    return [float(v) for v in np.concatenate([np.zeros(degree + 1 - len(out)), out])] if len(out) <= degree + 1 else [float(v) for v in out[-degree - 1 :]]
