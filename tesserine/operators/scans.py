"""Positions and running aggregates over long axes.

A window without a partition would bring a whole axis to one task. Here an axis
is cut into blocks by position: each block is scanned by itself, the blocks'
totals are scanned in the same way, and each cell adds the total before its
block. The depth is the logarithm of the length to the base ``BLOCK``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.array import SparkArray, names
from ..plans.shapes import axis_of

BLOCK = 1 << 16

#: name: (aggregate, neutral element, how two partial results meet)
SCANS: dict[str, tuple[Callable[[Column], Column], object, Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, 0, lambda a, b: a + b),
    "prod": (F.product, 1.0, lambda a, b: a * b),
    "min": (F.min, None, F.least),
    "max": (F.max, None, F.greatest),
}


def scan(df: DataFrame, value: str, out: str, kind: str, pos: str = "pos", by: tuple[str, ...] = (), length: int | None = None) -> DataFrame:
    """``df`` with the running aggregate of ``value`` up to each row in ``out``.

    ``pos`` orders the rows, uniquely within ``by``; ``length`` bounds it (None:
    not known, one block a group).
    """
    agg, _, meet = SCANS[kind]
    order = Window.partitionBy(*by, "__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    if length is None or length <= BLOCK:
        return df.withColumn("__block", F.lit(0)).withColumn(out, agg(value).over(order)).drop("__block")
    cut = df.withColumn("__block", F.floor(F.col(pos) / BLOCK))
    local = cut.withColumn("__local", agg(value).over(order))
    totals = cut.groupBy(*by, F.col("__block").alias("__outer")).agg(agg(value).alias("__total"))
    before = scan(totals, "__total", "__sum", kind, "__outer", by, -(-length // BLOCK))
    before = before.select(*by, (F.col("__outer") + 1).alias("__block"), F.col("__sum").alias("__upto"))
    both = local.join(before, [*by, "__block"], "left")
    return both.withColumn(out, F.when(F.col("__upto").isNull(), F.col("__local")).otherwise(meet(F.col("__upto"), F.col("__local")))).drop(
        "__block", "__local", "__upto"
    )


def positions(df: DataFrame, at: str, length: int) -> tuple[DataFrame, int]:
    """``df`` with a gapless ``pos`` in the order of the unique number ``at`` below ``length``, and the count."""
    ranked = scan(df.withColumn("__one", F.lit(1).cast("bigint")), "__one", "__rank", "sum", at, (), length)
    return ranked.withColumn("pos", F.col("__rank") - 1).drop("__one", "__rank"), df.count()


def cumulative(a: SparkArray, kind: str, axis: int | None = None) -> SparkArray:
    """cumsum, cumprod, cummin or cummax; without an axis over the flattened array."""
    if axis is None and a.rank != 1:
        return cumulative(a.flatten(), kind, 0)
    axis = axis_of(axis or 0, a.rank)
    by = tuple(n for k, n in enumerate(a.index) if k != axis)
    df = a.df
    if a.dtype == "boolean":
        df = df.withColumn("v", F.col("v").cast("int"))
    if kind in ("min", "max"):  # NaN, once met, stays
        df = df.withColumn("__nan", F.isnan("v").cast("int")) if a.dtype.startswith("f") else df.withColumn("__nan", F.lit(0))
        df = scan(df, "__nan", "__seen", "max", f"i{axis}", by, a.shape[axis])
    got = scan(df, "v", "__out", kind, f"i{axis}", by, a.shape[axis])
    value = F.col("__out")
    if kind in ("min", "max"):
        value = F.when(F.col("__seen") == 1, F.lit(float("nan"))).otherwise(value)
    return SparkArray(got.select(*a.index, value.alias("v")), a.shape, "int32" if a.dtype == "boolean" else a.dtype)


def shifted(a: SparkArray, by: int, axis: int, name: str) -> DataFrame:
    """Cells of ``a`` with their coordinate on ``axis`` moved by ``by`` and the value named ``name``; a join, no sort."""
    n = f"i{axis}"
    return a.df.select(*((F.col(c) + by).alias(c) if c == n else F.col(c) for c in a.index), F.col("v").alias(name))


def neighbours(a: SparkArray, axis: int, offsets: tuple[int, ...]) -> DataFrame:
    """Each cell with the values at ``offsets`` along ``axis`` as columns n0, n1, ...: one shuffle by block, then a window.

    Blocks overlap by the widest offset, so no window runs over a whole axis.
    """
    axis = axis_of(axis, a.rank)
    n, wide = f"i{axis}", max(abs(o) for o in offsets)
    by = [c for c in a.index if c != n]
    w = Window.partitionBy(*by, "__block").orderBy(n)
    block = F.floor(F.col(n) / BLOCK)
    if a.shape[axis] <= BLOCK:
        cells = a.df.withColumn("__block", F.lit(0)).withColumn("__home", F.lit(0))
    else:
        homes = F.array_distinct(F.array(F.floor((F.col(n) - wide) / BLOCK), block, F.floor((F.col(n) + wide) / BLOCK)))
        cells = a.df.withColumn("__home", block).withColumn("__block", F.explode(homes))
    seen = cells
    for k, o in enumerate(offsets):
        seen = seen.withColumn(f"n{k}", F.col("v") if o == 0 else F.lead("v", o).over(w) if o > 0 else F.lag("v", -o).over(w))
    return seen.where(F.col("__home") == F.col("__block")).drop("__home", "__block")


def diff(a: SparkArray, n: int = 1, axis: int = -1) -> SparkArray:
    """The n-th difference along an axis."""
    axis = axis_of(axis, a.rank)
    for _ in range(n):
        if a.shape[axis] < 2:
            shape = tuple(0 if k == axis else d for k, d in enumerate(a.shape))
            return SparkArray(a.df.where(F.lit(False)), shape, a.dtype)
        near = neighbours(a, axis, (1,))
        change = (F.col("n0") != F.col("v")) if a.dtype == "boolean" else F.col("n0") - F.col("v")
        shape = tuple(d - 1 if k == axis else d for k, d in enumerate(a.shape))
        a = SparkArray(near.where(F.col(f"i{axis}") < shape[axis]).select(*a.index, change.alias("v")), shape, a.dtype)
    return a


def _spaced(a: SparkArray, axis: int, spacing) -> SparkArray:
    """``a`` with struct cells (v, x): the coordinates come from a step or an array along the axis."""
    if isinstance(spacing, SparkArray):
        x = spacing.df.select(F.col("i0").alias(f"i{axis}"), F.col("v").alias("x"))
        df = a.df.join(x, f"i{axis}")
    else:
        df = a.df.withColumn("x", F.col(f"i{axis}") * float(spacing))
    return SparkArray(df.select(*a.index, F.struct(F.col("v").cast("double").alias("v"), "x").alias("v")), a.shape, a.dtype)


def trapz(a: SparkArray, spacing=1.0, axis: int = -1) -> SparkArray:
    """The composite trapezoid rule along an axis; spacing is a step or an array of coordinates."""
    axis = axis_of(axis, a.rank)
    s = _spaced(a, axis, spacing)
    near = neighbours(s, axis, (1,)).where(F.col("n0").isNotNull())
    by = [n for n in a.index if n != f"i{axis}"]
    area = F.coalesce(F.sum((F.col("v.v") + F.col("n0.v")) / 2 * (F.col("n0.x") - F.col("v.x"))), F.lit(0.0)).alias("v")
    df = near.groupBy(*by).agg(area)
    shape = tuple(d for k, d in enumerate(a.shape) if k != axis)
    return SparkArray(df.select(*(F.col(n).alias(m) for n, m in zip(by, names(len(by)))), "v"), shape)


def gradient(a: SparkArray, spacing=1.0, axis: int = 0, edge_order: int = 1) -> SparkArray:
    """Central differences inside, one-sided ones of first or second order at the edges."""
    axis = axis_of(axis, a.rank)
    n = a.shape[axis]
    if edge_order not in (1, 2) or n < edge_order + 1:
        raise ValueError("too few cells for the edges")
    near = neighbours(_spaced(a, axis, spacing), axis, (-2, -1, 1, 2))
    v, x = F.col("v.v"), F.col("v.x")
    (p2, p1, q1, q2), (xp2, xp1, xq1, xq2) = zip(*((F.col(f"n{k}.v"), F.col(f"n{k}.x")) for k in range(4)))
    hd, hs = xq1 - x, x - xp1
    inner = (hs * hs * q1 + (hd * hd - hs * hs) * v - hd * hd * p1) / (hs * hd * (hd + hs))
    if edge_order == 1:
        first, last = (q1 - v) / (xq1 - x), (v - p1) / (x - xp1)
    else:
        d1, d2 = xq1 - x, xq2 - xq1
        first = -(2 * d1 + d2) / (d1 * (d1 + d2)) * v + (d1 + d2) / (d1 * d2) * q1 - d1 / (d2 * (d1 + d2)) * q2
        e1, e2 = xp1 - xp2, x - xp1
        last = e2 / (e1 * (e1 + e2)) * p2 - (e2 + e1) / (e1 * e2) * p1 + (2 * e2 + e1) / (e2 * (e1 + e2)) * v
    at = F.col(f"i{axis}")
    return SparkArray(near.select(*a.index, F.when(at == 0, first).when(at == n - 1, last).otherwise(inner).alias("v")), a.shape)


def gradients(a: SparkArray, spacing=1.0, axes=None, edge_order: int = 1) -> list[SparkArray]:
    from ..plans.shapes import axes_of

    on = axes_of(axes, a.rank)
    steps = spacing if isinstance(spacing, (list, tuple)) else [spacing] * len(on)
    return [gradient(a, s, k, edge_order) for s, k in zip(steps, on, strict=True)]


def unwrap(a: SparkArray, discont: float = math.pi, axis: int = -1) -> SparkArray:
    """Multiples of 2 pi added so that no step along the axis exceeds ``discont``."""
    axis = axis_of(axis, a.rank)
    near = neighbours(a, axis, (-1,))
    d = F.col("v") - F.col("n0")
    folded = d - 2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))
    folded = F.when((folded == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(folded)
    step = F.when(F.abs(d) < discont, F.lit(0.0)).otherwise(folded - d)
    fixed = near.select(*a.index, F.col("v").alias("__raw"), F.coalesce(step, F.lit(0.0)).alias("__step"))
    by = tuple(n for n in a.index if n != f"i{axis}")
    got = scan(fixed, "__step", "__sum", "sum", f"i{axis}", by, a.shape[axis])
    return SparkArray(got.select(*a.index, (F.col("__raw") + F.col("__sum")).alias("v")), a.shape)


def sliding_windows(a: SparkArray, window, axis=None) -> SparkArray:
    """Every window of a shape: the window axes come last."""
    from ..plans.shapes import axes_of

    sizes = (window,) if isinstance(window, int) else tuple(window)
    on = axes_of(axis, a.rank) if axis is not None else tuple(range(a.rank))
    df, shape = a.df, list(a.shape)
    for k, (ax, w) in enumerate(zip(on, sizes, strict=True)):
        shape[ax] -= w - 1
        if shape[ax] < 1:
            raise ValueError("a window is longer than its axis")
        df = df.withColumn(f"w{k}", F.explode(F.sequence(F.lit(0), F.lit(w - 1)))).withColumn(f"i{ax}", F.col(f"i{ax}") - F.col(f"w{k}"))
        df = df.where((F.col(f"i{ax}") >= 0) & (F.col(f"i{ax}") < shape[ax]))
    cols = [*a.index, *(f"w{k}" for k in range(len(on)))]
    return SparkArray(df.select(*(F.col(c).cast("bigint").alias(n) for c, n in zip(cols, names(len(cols)))), "v"), (*shape, *sizes), a.dtype)
