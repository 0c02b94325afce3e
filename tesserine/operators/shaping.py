"""Creation, joining, splitting, tiling, padding and diagonals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes
from ..plans.array import SparkArray, axis_frame, names, small
from ..plans.shapes import NewAxis, Slice, axis_of, broadcast_shapes, size


# creation: ranges and literals, no data read
def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Coordinates of every cell, from one range."""
    n, left = spark.range(size(shape)), size(shape)
    cols = []
    for k, d in enumerate(shape):
        left //= max(d, 1)
        cols.append(((F.col("id") / left).cast("bigint") if left > 1 else F.col("id")).alias(f"i{k}") if k == 0 else (F.floor(F.col("id") / left) % d).cast("bigint").alias(f"i{k}"))
    return n.select(*cols) if shape else spark.range(1).select()


def full(spark: SparkSession, shape: Sequence[int], value, dtype: str = "float64") -> SparkArray:
    base = grid(spark, shape) if shape else spark.range(1)
    return SparkArray(base.select(*names(len(shape)), F.lit(value).cast(dtypes.SPARK[dtype][1]).alias("v")), shape, dtype)


def zeros(spark, shape, dtype="float64"):
    return full(spark, shape, 0, dtype)


def ones(spark, shape, dtype="float64"):
    return full(spark, shape, 1, dtype)


def scalar(spark, value, dtype="float64"):
    return full(spark, (), value, dtype)


def _ranged(spark, n: int, make, dtype="float64") -> SparkArray:
    return SparkArray(spark.range(n).select(F.col("id").alias("i0"), make(F.col("id")).cast(dtypes.SPARK[dtype][1]).alias("v")), (n,), dtype)


def arange(spark, start: float, stop: float, step: float = 1.0, dtype="float64"):
    if step == 0:
        raise ValueError("a step is not 0")
    return _ranged(spark, max(0, math.ceil((stop - start) / step)), lambda i: start + i * step, dtype)


def linspace(spark, start: float, stop: float, n: int, endpoint: bool = True, dtype="float64"):
    return linspace_with_step(spark, start, stop, n, endpoint, dtype)[0]


def linspace_with_step(spark, start, stop, n, endpoint=True, dtype="float64"):
    parts = n - 1 if endpoint else n
    step = (stop - start) / parts if parts > 0 else math.nan
    return _ranged(spark, n, lambda i: F.when((i == n - 1) & F.lit(endpoint and n > 1), F.lit(float(stop))).otherwise(start + i * (step if parts > 0 else 0.0)), dtype), step


def logspace(spark, start, stop, n, base=10.0, endpoint=True):
    return linspace(spark, start, stop, n, endpoint).map(lambda v: F.pow(F.lit(float(base)), v))


def geomspace(spark, start, stop, n, endpoint=True):
    if start == 0 or stop == 0 or (start < 0) != (stop < 0):
        raise ValueError("a geometric progression keeps its sign")
    parts = max(n - 1 if endpoint else n, 1)
    return _ranged(spark, n, lambda i: F.when((i == n - 1) & F.lit(endpoint and n > 1), F.lit(float(stop))).otherwise(start * F.pow(F.lit(stop / start), i / parts)))


def spaced_grid(start: SparkArray, stop: SparkArray, n: int, kind: str = "linear", endpoint: bool = True, axis: int = 0, base: float = 10.0) -> SparkArray:
    """linspace, logspace or geomspace between the cells of two arrays, along a new axis."""
    ends, shape = start.paired(stop)
    parts = max(n - 1 if endpoint else n, 1)
    t = F.col("__t") / parts
    line = F.col("v") + (F.col("w") - F.col("v")) * t
    value = {"linear": line, "log": F.pow(F.lit(base), line), "geom": F.col("v") * F.pow(F.col("w") / F.col("v"), t)}[kind]
    cells = ends.crossJoin(small(axis_frame(start.spark, "__t", n), (n,)))
    got = SparkArray(cells.select(F.col("__t").alias("i0"), *(F.col(c).alias(f"i{k + 1}") for k, c in enumerate(names(len(shape)))), value.alias("v")), (n, *shape))
    return got.moveaxis(0, axis)


def eye(spark, n: int, dtype="float64"):
    return SparkArray(grid(spark, (n, n)).select("i0", "i1", (F.col("i0") == F.col("i1")).cast("int").cast(dtypes.SPARK[dtype][1]).alias("v")), (n, n), dtype)


def mgrid(spark, ranges: list[tuple[float, float, float]]) -> SparkArray:
    """Dense coordinates: the first axis names the coordinate."""
    counts = [max(0, math.ceil((b - a) / s)) for a, b, s in ranges]
    cells = grid(spark, counts).withColumn("__v", F.array(*(F.lit(float(a)) + F.col(f"i{k}") * F.lit(float(s)) for k, (a, _, s) in enumerate(ranges))))
    cells = cells.select(*(F.col(c).alias(f"i{k + 1}") for k, c in enumerate(names(len(counts)))), F.posexplode("__v").alias("i0", "v"))
    return SparkArray(cells.select(F.col("i0").cast("bigint").alias("i0"), *names(len(counts) + 1)[1:], "v"), (len(counts), *counts))


def ogrid(spark, ranges: list[tuple[float, float, float]]) -> list[SparkArray]:
    k = len(ranges)
    return [arange(spark, a, b, s)[[Slice() if j == i else NewAxis for j in range(k)]] for i, (a, b, s) in enumerate(ranges)]


def _window(spark, m: int, a: float, b: float) -> SparkArray:
    return ones(spark, (m,)) if m == 1 else _ranged(spark, m, lambda n: a - b * F.cos(2 * math.pi * n / (m - 1)))


def hanning(spark, m):
    return _window(spark, m, 0.5, 0.5)


def hamming(spark, m):
    return _window(spark, m, 0.54, 0.46)


def fftfreq(spark, n: int, d: float = 1.0):
    return _ranged(spark, n, lambda i: F.when(i < (n + 1) // 2, i).otherwise(i - n) / (d * n))


def rfftfreq(spark, n: int, d: float = 1.0):
    return _ranged(spark, n // 2 + 1, lambda i: i / (d * n))


# joining
def concatenate(arrays: list[SparkArray], axis: int = 0) -> SparkArray:
    first = arrays[0]
    axis = axis_of(axis, first.rank)
    dtype, at, out = first.dtype, 0, None
    for a in arrays:
        if a.rank != first.rank or any(x != y for k, (x, y) in enumerate(zip(a.shape, first.shape)) if k != axis):
            raise ValueError("shapes differ beside the axis")
        dtype = dtypes.promote(dtype, a.dtype) if dtype != a.dtype else dtype
    for a in arrays:
        part = a.astype(dtype).df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        out, at = part if out is None else out.unionByName(part), at + a.shape[axis]
    return SparkArray(out, [at if k == axis else d for k, d in enumerate(first.shape)], dtype)


def stack(arrays: list[SparkArray], axis: int = 0) -> SparkArray:
    return concatenate([a.expand_dims(axis) for a in arrays], axis)


def _at_least(a: SparkArray, rank: int) -> SparkArray:
    while a.rank < rank:
        a = a.expand_dims(0) if a.rank < 2 else a.expand_dims(2)
    return a


def vstack(arrays):
    return concatenate([_at_least(a, 2) for a in arrays], 0)


def hstack(arrays):
    arrays = [_at_least(a, 1) for a in arrays]
    return concatenate(arrays, 0 if arrays[0].rank == 1 else 1)


def dstack(arrays):
    return concatenate([_at_least(a, 3) for a in arrays], 2)


def column_stack(arrays):
    return concatenate([a.expand_dims(1) if a.rank == 1 else a for a in arrays], 1)


# splitting
def array_split_at(a: SparkArray, indices: Sequence[int], axis: int = 0) -> list[SparkArray]:
    axis = axis_of(axis, a.rank)
    n = a.shape[axis]
    cuts = [0, *indices, n]
    return [a[[Slice(s, e) if k == axis else Slice() for k in range(a.rank)]] for s, e in zip(cuts, cuts[1:])]


def array_split(a: SparkArray, sections: int, axis: int = 0) -> list[SparkArray]:
    if sections < 1:
        raise ValueError("one section at least")
    n, cuts = a.shape[axis_of(axis, a.rank)], []
    for k in range(1, sections):
        cuts.append(k * (n // sections) + min(k, n % sections))
    return array_split_at(a, cuts, axis)


def split(a: SparkArray, sections: int, axis: int = 0) -> list[SparkArray]:
    if a.shape[axis_of(axis, a.rank)] % sections:
        raise ValueError("sections are not equal")
    return array_split(a, sections, axis)


split_at = array_split_at


def _h(a):
    return 0 if a.rank == 1 else 1


def hsplit(a, sections):
    return split(a, sections, _h(a))


def hsplit_at(a, indices):
    return split_at(a, indices, _h(a))


def vsplit(a, sections):
    return split(a, sections, 0)


def vsplit_at(a, indices):
    return split_at(a, indices, 0)


def dsplit(a, sections):
    return split(a, sections, 2)


def dsplit_at(a, indices):
    return split_at(a, indices, 2)


# repetition
def repeat(a: SparkArray, repeats: int | Sequence[int], axis: int | None = None) -> SparkArray:
    if axis is None:
        return repeat(a.flatten(), repeats, 0)
    axis = axis_of(axis, a.rank)
    n, c = a.shape[axis], f"i{axis}"
    if isinstance(repeats, int):
        cells = a.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))) if repeats > 0 else a.df.where(F.lit(False)).withColumn("__k", F.lit(0))
        cells, total = cells.withColumn(c, (F.col(c) * repeats + F.col("__k")).cast("bigint")).drop("__k"), n * repeats
    else:
        if len(repeats) != n:
            raise ValueError("a count for each position")
        at, rows = 0, []
        for k, r in enumerate(repeats):
            rows += [(k, at + j) for j in range(r)]
            at += r
        lookup = a.spark.createDataFrame(rows or [(-1, 0)], f"{c} bigint, __to bigint")
        cells, total = a.df.join(F.broadcast(lookup), c).withColumn(c, F.col("__to")).drop("__to"), at  # the caller's list
    return SparkArray(cells.select(*a.index, "v"), [total if k == axis else d for k, d in enumerate(a.shape)], a.dtype)


def tile(a: SparkArray, reps: Sequence[int]) -> SparkArray:
    reps = [1] * (a.rank - len(reps)) + list(reps)
    while a.rank < len(reps):
        a = a.expand_dims(0)
    df = a.df
    for k, r in enumerate(reps):
        if r != 1:
            df = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))) if r else df.where(F.lit(False)).withColumn("__k", F.lit(0))
            df = df.withColumn(f"i{k}", (F.col(f"i{k}") + F.col("__k") * a.shape[k]).cast("bigint")).drop("__k")
    return SparkArray(df.select(*a.index, "v"), [d * r for d, r in zip(a.shape, reps)], a.dtype)


# diagonals and triangles
def diag(a: SparkArray, k: int = 0) -> SparkArray:
    if a.rank == 1:
        n = a.shape[0] + abs(k)
        down, right = max(-k, 0), max(k, 0)
        own = a.df.select((F.col("i0") + down).alias("i0"), (F.col("i0") + right).alias("i1"), "v")
        cells = grid(a.spark, (n, n)).join(own, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("v", F.lit(0).cast(dtypes.SPARK[a.dtype][1])).alias("v"))
        return SparkArray(cells, (n, n), a.dtype)
    return diagonal(a, k)


def diagonal(a: SparkArray, k: int = 0) -> SparkArray:
    m, n = a.shape
    length = max(0, min(m + min(k, 0), n - max(k, 0)))
    return SparkArray(a.df.where(F.col("i1") - F.col("i0") == k).select((F.col("i0") - max(-k, 0)).alias("i0"), "v"), (length,), a.dtype)


def _triangle(a: SparkArray, keep) -> SparkArray:
    i, j = F.col(f"i{a.rank - 2}"), F.col(f"i{a.rank - 1}")
    zero = F.lit(0).cast(dtypes.SPARK[a.dtype][1])
    return SparkArray(a.df.select(*a.index, F.when(keep(j - i), F.col("v")).otherwise(zero).alias("v")), a.shape, a.dtype)


def tril(a, k: int = 0):
    return _triangle(a, lambda d: d <= k)


def triu(a, k: int = 0):
    return _triangle(a, lambda d: d >= k)


def as_strided(a: SparkArray, shape: Sequence[int], strides: Sequence[int]) -> SparkArray:
    """A view of the flat cells by any strides, which may overlap."""
    at = F.lit(0).cast("bigint")
    for c, s in zip(names(len(shape)), strides, strict=True):
        at = at + F.col(c) * s
    want = grid(a.spark, shape).withColumn("__f", at)
    return SparkArray(want.join(a.df.select(a.flat().alias("__f"), "v"), "__f").select(*names(len(shape)), "v"), shape, a.dtype)


#: The modes of pad.
PAD_MODES = ("constant", "edge", "reflect", "symmetric", "wrap", "linearRamp", "mean", "median", "min", "max")


def pad(a: SparkArray, widths, mode: str = "constant", value=0, end=0.0, stat_length: int | None = None) -> SparkArray:
    """Cells before and after each axis, one axis after the other."""
    if mode not in PAD_MODES:
        raise ValueError(f"unknown mode {mode}")
    widths = [(widths, widths)] * a.rank if isinstance(widths, int) else [tuple(w) for w in widths]
    if any(w < 0 for pair in widths for w in pair):
        raise ValueError("a width is not negative")
    for k, (before, after) in enumerate(widths):
        if before or after:
            a = _padded(a, k, before, after, mode, value, end, stat_length)
    return a


def _padded(a: SparkArray, k: int, before: int, after: int, mode: str, value, end, stat_length) -> SparkArray:
    from .reductions import reduced

    n, c = a.shape[k], f"i{k}"
    shape = [d + before + after if j == k else d for j, d in enumerate(a.shape)]
    moved = a.df.withColumn(c, F.col(c) + before)
    others = [x for x in a.index if x != c]
    kind = dtypes.SPARK[a.dtype][1]
    if n == 0 and mode != "constant":
        raise ValueError("an empty axis has no edge")
    spots = [*range(before), *range(before + n, before + n + after)]
    if mode in ("edge", "reflect", "symmetric", "wrap"):
        def source(t: int) -> int:
            x = t - before
            if mode == "edge":
                return min(max(x, 0), n - 1)
            if mode == "wrap":
                return x % n
            period = 2 * n if mode == "symmetric" else max(2 * n - 2, 1)
            x %= period
            return x if x < n else (period - 1 - x if mode == "symmetric" else period - x)

        lookup = a.spark.createDataFrame([(source(t), t) for t in spots], f"{c} bigint, __to bigint")
        extra = a.df.join(small(lookup, (len(spots),)), c).withColumn(c, F.col("__to")).drop("__to")
    else:
        new = small(a.spark.createDataFrame([(t,) for t in spots], f"{c} bigint"), (len(spots),))
        if mode == "constant":
            rest = grid(a.spark, [a.shape[j] for j in range(a.rank) if j != k]).toDF(*others) if others else None
            extra = (rest.crossJoin(new) if others else new).withColumn("v", F.lit(value).cast(kind))
        elif mode == "linearRamp":
            edges = a.df.where((F.col(c) == 0) | (F.col(c) == n - 1)).select(*others, (F.col(c) == 0).alias("__low"), "v")
            if n == 1:
                edges = edges.drop("__low").crossJoin(a.spark.createDataFrame([(True,), (False,)], "__low boolean"))
            new = new.withColumn("__low", F.col(c) < before)
            far = F.when(F.col("__low"), (F.lit(before) - F.col(c)) / max(before, 1)).otherwise((F.col(c) - (before + n - 1)) / max(after, 1))
            ramp = edges.join(new, "__low")
            extra = ramp.select(*others, c, (F.col("v") + (F.lit(float(end)) - F.col("v")) * far).cast(kind).alias("v"))
        else:
            how = {"mean": F.avg("v"), "median": F.percentile("v", F.lit(0.5)), "min": F.min("v"), "max": F.max("v")}[mode]
            near = stat_length or n
            parts = []
            for low, take in ((True, F.col(c) < near), (False, F.col(c) >= n - near)):
                stat = reduced(SparkArray(a.df.where(take), a.shape, a.dtype), how, k, True).df.drop(c)
                parts.append(stat.crossJoin(new.where(F.col(c) < before if low else F.col(c) >= before)))
            extra = parts[0].unionByName(parts[1]).withColumn("v", F.col("v").cast(kind))
    return SparkArray(moved.select(*a.index, "v").unionByName(extra.select(*a.index, "v")), shape, a.dtype)


def nd_iter(*arrays: SparkArray):
    """Broadcast cells of several arrays in C order: (coordinates, values)."""
    shape = broadcast_shapes(*(a.shape for a in arrays))
    df = None
    for k, a in enumerate(arrays):
        part = a.broadcast_to(shape).df.withColumnRenamed("v", f"v{k}")
        df = part if df is None else df.join(part, names(len(shape)))
    for row in df.orderBy(*names(len(shape))).toLocalIterator():
        yield tuple(row[n] for n in names(len(shape))), tuple(row[f"v{k}"] for k in range(len(arrays)))
