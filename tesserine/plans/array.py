"""Dense N-dimensional arrays as coordinate DataFrames.

An array of rank k is a DataFrame of columns i0 to i(k-1) and v, one row a
cell, with its shape and element type on the driver. Every method returns a new
array over a lazy plan; nothing is mutated. Rows have no order: coordinates
carry it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes, ufuncs
from .shapes import Index, Indices, Mask, NewAxis, Shape, Slice, axes_of, axis_of, broadcast_shapes, c_strides, reshaped, selectors, size

#: Cells of an operand that is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_CELLS = 1 << 18


def names(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def small(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """``df`` marked for broadcast where its shape bounds it."""
    return F.broadcast(df) if size(shape) <= BROADCAST_CELLS else df


class SparkArray:
    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: str = "float64"):
        self.df, self.shape, self.dtype = df, tuple(int(d) for d in shape), dtype

    # construction and reading
    @staticmethod
    def of(spark: SparkSession, values, dtype: str | None = None) -> SparkArray:
        """From a small numpy array or nested list."""
        a = np.asarray(values)
        dtype = dtype or {"b": "boolean", "i": "int64", "u": "int64", "f": "float64", "c": "complex128"}[a.dtype.kind]
        kind = dtypes.SPARK[dtype][1]
        schema = "".join(f"{n} bigint, " for n in names(a.ndim)) + f"v {kind}"

        def cell(x):
            if dtype.startswith("complex"):
                return (float(np.real(x)), float(np.imag(x)))
            if dtypes.kind(dtype) == "float":
                return float(x)
            return bool(x) if dtype == "boolean" else int(x)

        rows = [(*map(int, at), cell(a[at])) for at in np.ndindex(a.shape)]
        return SparkArray(spark.createDataFrame(rows, schema), a.shape, dtype)

    @staticmethod
    def packed(df: DataFrame, key: str, values: str, rows: int, width: int, dtype: str = "float64") -> SparkArray:
        """Rows of arrays, with ``key`` 0 to rows - 1, as a matrix."""
        cells = df.select(F.col(key).cast("bigint").alias("i0"), F.posexplode(values).alias("i1", "v"))
        return SparkArray(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), F.col("v").cast(dtypes.SPARK[dtype][1]).alias("v")), (rows, width), dtype)

    def numpy(self) -> np.ndarray:
        """The cells on the driver: for results that are known to be small."""
        out = np.empty(self.shape, complex if self.dtype.startswith("complex") else {"float": float, "bool": bool}.get(dtypes.kind(self.dtype), object if self.dtype == "uint64" else np.int64))
        for row in self.df.toLocalIterator():
            v = row["v"]
            v = complex(v["re"], v["im"]) if self.dtype.startswith("complex") and v is not None else v
            out[tuple(row[n] for n in self.index)] = np.nan if v is None and out.dtype == float else v
        return out

    def to_list(self):
        return self.numpy().tolist()

    def enumerate(self):
        """(coordinates, value) in C order, streamed."""
        for row in self.df.orderBy(*self.index).toLocalIterator():
            yield tuple(row[n] for n in self.index), row["v"]

    def item(self, *at: int):
        at = [a % d for a, d in zip(at, self.shape, strict=True)]
        rows = self.df.where(F.lit(True) if not at else sum_all([F.col(n) == a for n, a in zip(self.index, at)])).select("v").head(1)
        return rows[0]["v"] if rows else None

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def index(self) -> list[str]:
        return names(self.rank)

    @property
    def size(self) -> int:
        return size(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def same_shape(self, other: SparkArray) -> bool:
        return self.shape == other.shape

    def flat(self) -> Column:
        """The C-order position of a cell."""
        at = F.lit(0).cast("bigint")
        for n, s in zip(self.index, c_strides(self.shape)):
            at = at + F.col(n) * s
        return at

    def packed_rows(self) -> DataFrame:
        """Leading coordinates and the last axis as an array, in order."""
        lead = self.index[:-1]
        cells = F.sort_array(F.collect_list(F.struct(self.index[-1], "v")))
        return self.df.groupBy(*lead).agg(F.transform(cells, lambda c: c["v"]).alias("v"))

    # element-wise
    def map(self, f: Callable[[Column], Column], dtype: str | None = None) -> SparkArray:
        return SparkArray(self.df.select(*self.index, f(F.col("v")).alias("v")), self.shape, dtype or self.dtype)

    def astype(self, dtype: str) -> SparkArray:
        return self.map(lambda v: dtypes.astype(v, self.dtype, dtype), dtype)

    def paired(self, other: SparkArray) -> tuple[DataFrame, Shape]:
        """Cells of both operands under broadcasting, as columns v and w."""
        shape = broadcast_shapes(self.shape, other.shape)
        a, b = self.broadcast_to(shape, lazy=True), other.broadcast_to(shape, lazy=True)
        shared = [n for n in names(len(shape)) if n in a.columns and n in b.columns]
        b = b.withColumnRenamed("v", "w")
        b = small(b, other.shape)
        both = a.join(b, shared) if shared else a.crossJoin(b)
        for k, n in enumerate(names(len(shape))):
            if n not in both.columns:
                both = both.crossJoin(small(axis_frame(self.spark, n, shape[k]), (shape[k],)))
        return both.select(*names(len(shape)), "v", "w"), shape

    def binary(self, other, f: Callable[[Column, Column], Column], dtype: str | None = None) -> SparkArray:
        if not isinstance(other, SparkArray):
            return self.map(lambda v: f(v, F.lit(other)), dtype)
        both, shape = self.paired(other)
        return SparkArray(both.select(*names(len(shape)), f(F.col("v"), F.col("w")).alias("v")), shape, dtype or dtypes.promote(self.dtype, other.dtype))

    def __add__(self, o):
        return self.binary(o, ufuncs.add)

    def __sub__(self, o):
        return self.binary(o, ufuncs.subtract)

    def __mul__(self, o):
        return self.binary(o, ufuncs.multiply)

    def __truediv__(self, o):
        return self.binary(o, ufuncs.divide, "float64")

    def __floordiv__(self, o):
        return self.binary(o, lambda a, b: ufuncs.floor_divide(a, b, whole="int" in self.dtype))

    def __mod__(self, o):
        return self.binary(o, lambda a, b: ufuncs.remainder(a, b, whole="int" in self.dtype))

    def __neg__(self):
        return self.map(ufuncs.negative)

    def __and__(self, o):
        return self.binary(o, ufuncs.bitwise_and)

    def __or__(self, o):
        return self.binary(o, ufuncs.bitwise_or)

    def __xor__(self, o):
        return self.binary(o, ufuncs.bitwise_xor)

    def __invert__(self):
        return self.map(ufuncs.logical_not if self.dtype == "boolean" else ufuncs.invert)

    def __lshift__(self, o):
        return self.binary(o, ufuncs.left_shift)

    def __rshift__(self, o):
        return self.binary(o, ufuncs.right_shift)

    def __gt__(self, o):
        return self.binary(o, ufuncs.greater, "boolean")

    def __ge__(self, o):
        return self.binary(o, ufuncs.greater_equal, "boolean")

    def __lt__(self, o):
        return self.binary(o, ufuncs.less, "boolean")

    def __le__(self, o):
        return self.binary(o, ufuncs.less_equal, "boolean")

    def eq(self, o):
        return self.binary(o, ufuncs.equal, "boolean")

    def equals(self, other: SparkArray) -> bool:
        """Same shape, type and cells."""
        if (self.shape, self.dtype) != (other.shape, other.dtype):
            return False
        return not self.df.exceptAll(other.df).head(1) and not other.df.exceptAll(self.df).head(1)

    # shape
    def _indexed(self, new: Sequence[Column], shape: Sequence[int], df: DataFrame | None = None, dtype: str | None = None) -> SparkArray:
        df = self.df if df is None else df
        return SparkArray(df.select(*(c.cast("bigint").alias(n) for c, n in zip(new, names(len(shape)))), "v"), shape, dtype or self.dtype)

    def reshape(self, *shape) -> SparkArray:
        shape = reshaped(self.shape, shape[0] if len(shape) == 1 and not isinstance(shape[0], int) else shape)
        at = self.flat()
        return self._indexed([F.floor(at / s) % d if s > 1 else at % d for s, d in zip(c_strides(shape), shape) if d] if 0 not in shape else [F.lit(0)] * len(shape), shape)

    def flatten(self) -> SparkArray:
        return self._indexed([self.flat()], (self.size,))

    ravel = flatten

    def copy(self) -> SparkArray:
        return SparkArray(self.df, self.shape, self.dtype)

    def fill(self, value) -> SparkArray:
        return self.map(lambda v: F.lit(value).cast(dtypes.SPARK[self.dtype][1]))

    def transpose(self, axes: Sequence[int] | None = None) -> SparkArray:
        axes = tuple(reversed(range(self.rank))) if axes is None else axes_of(axes, self.rank)
        if len(axes) != self.rank:
            raise ValueError("as many axes as the rank")
        return self._indexed([F.col(f"i{a}") for a in axes], [self.shape[a] for a in axes])

    def swapaxes(self, a: int, b: int) -> SparkArray:
        order = list(range(self.rank))
        a, b = axis_of(a, self.rank), axis_of(b, self.rank)
        order[a], order[b] = order[b], order[a]
        return self.transpose(order)

    def moveaxis(self, source, destination) -> SparkArray:
        s, d = axes_of(source, self.rank), axes_of(destination, self.rank)
        order = [a for a in range(self.rank) if a not in s]
        for to, own in sorted(zip(d, s, strict=True)):
            order.insert(to, own)
        return self.transpose(order)

    def expand_dims(self, axis: int) -> SparkArray:
        axis = axis_of(axis, self.rank + 1)
        new = [F.col(n) for n in self.index]
        return self._indexed([*new[:axis], F.lit(0), *new[axis:]], (*self.shape[:axis], 1, *self.shape[axis:]))

    def squeeze(self, axis=None) -> SparkArray:
        gone = {k for k, d in enumerate(self.shape) if d == 1} if axis is None else set(axes_of(axis, self.rank))
        if any(self.shape[k] != 1 for k in gone):
            raise ValueError("only axes of length 1 go")
        keep = [k for k in range(self.rank) if k not in gone]
        return self._indexed([F.col(f"i{k}") for k in keep], [self.shape[k] for k in keep])

    def broadcast_to(self, shape: Sequence[int], lazy: bool = False):
        """Stretched to ``shape``; lazy: the frame without its stretched axes, for a join to supply."""
        if broadcast_shapes(self.shape, shape) != tuple(shape):
            raise ValueError(f"{self.shape} doesn't stretch to {tuple(shape)}")
        lead = len(shape) - self.rank
        own = [k for k, d in enumerate(self.shape) if not (d == 1 and shape[lead + k] != 1)]
        df = self.df.select(*(F.col(f"i{k}").alias(f"i{lead + k}") for k in own), "v")
        if lazy:
            return df
        for k, n in enumerate(names(len(shape))):
            if n not in df.columns:
                df = df.crossJoin(small(axis_frame(self.spark, n, shape[k]), (shape[k],)))
        return SparkArray(df.select(*names(len(shape)), "v"), shape, self.dtype)

    def flip(self, axis=None) -> SparkArray:
        on = axes_of(axis, self.rank)
        return self._indexed([(self.shape[k] - 1 - F.col(n)) if k in on else F.col(n) for k, n in enumerate(self.index)], self.shape)

    def roll(self, shift, axis=None) -> SparkArray:
        if axis is None:
            return self.flatten().roll(shift, 0).reshape(self.shape)
        by: dict[int, int] = {}
        for s, a in zip((shift,) if isinstance(shift, int) else shift, (axis,) if isinstance(axis, int) else axis, strict=True):
            by[axis_of(a, self.rank)] = by.get(axis_of(a, self.rank), 0) + s
        new = [F.pmod(F.col(n) + by[k] % max(self.shape[k], 1), F.lit(max(self.shape[k], 1))) if k in by else F.col(n) for k, n in enumerate(self.index)]
        return self._indexed(new, self.shape)

    def rot90(self, k: int = 1, axes: Sequence[int] = (0, 1)) -> SparkArray:
        a, b = axes_of(tuple(axes), self.rank)
        k %= 4
        if k == 0:
            return self.copy()
        if k == 2:
            return self.flip((a, b))
        return self.flip(b).swapaxes(a, b) if k == 1 else self.swapaxes(a, b).flip(b)

    # selection
    def __getitem__(self, spec) -> SparkArray:
        if isinstance(spec, SparkArray):
            return self.apply_mask(spec) if spec.dtype == "boolean" else self.take_array(spec)
        df, shape, new, axis = self.df, [], [], 0
        for p in selectors(spec, self.shape):
            if p is NewAxis:
                shape.append(1)
                new.append(F.lit(0))
                continue
            n, d, name = self.shape[axis], axis, f"i{axis}"
            axis += 1
            if isinstance(p, Index):
                if not -n <= p.value < n:
                    raise IndexError(f"{p.value} is beyond axis {d} of length {n}")
                df = df.where(F.col(name) == p.value % n)
                continue
            if isinstance(p, Slice):
                r = p.over(n)
                shape.append(len(r))
                if len(r) == 0:
                    df = df.where(F.lit(False))
                    new.append(F.col(name))
                elif r == range(n):
                    new.append(F.col(name))
                else:
                    low, high = min(r[0], r[-1]), max(r[0], r[-1])
                    df = df.where((F.col(name) >= low) & (F.col(name) <= high) & ((F.col(name) - r.start) % abs(r.step) == 0))
                    new.append(((F.col(name) - r.start) / r.step).cast("bigint"))
                continue
            if isinstance(p, Mask):
                if len(p.flags) != n:
                    raise ValueError("a mask is as long as its axis")
                p = Indices(k for k, f in enumerate(p.flags) if f)
            if any(not -n <= v < n for v in p.values):
                raise IndexError("an index is beyond its axis")
            lookup = self.spark.createDataFrame([(v % n, k) for k, v in enumerate(p.values)] or [(-1, 0)], f"{name} bigint, __{d} bigint")
            df = df.join(F.broadcast(lookup), name)  # as long as the list that the caller wrote
            shape.append(len(p.values))
            new.append(F.col(f"__{d}"))
        return self._indexed(new, shape, df)

    slice = __getitem__

    def take(self, indices: Sequence[int], axis: int = 0) -> SparkArray:
        return self[[Indices(indices) if k == axis_of(axis, self.rank) else Slice() for k in range(self.rank)]]

    def take_array(self, indices: SparkArray) -> SparkArray:
        """Rows of axis 0 by an array of positions."""
        n, r = self.shape[0], indices.rank
        at = indices.df.select(*(F.col(c).alias(f"o{k}") for k, c in enumerate(indices.index)), F.pmod("v", F.lit(n)).alias("i0"))
        both = self.df.join(at, "i0")
        return self._indexed([*(F.col(f"o{k}") for k in range(r)), *(F.col(f"i{k}") for k in range(1, self.rank))], (*indices.shape, *self.shape[1:]), both)

    def apply_mask(self, mask: SparkArray) -> SparkArray:
        """The cells whose flag is true, in C order. Counts the cells."""
        from ..operators.scans import positions

        if mask.shape != self.shape:
            raise ValueError("a mask has the array's shape")
        both, _ = self.paired(mask)
        chosen = both.where("w").select(self.flat().alias("__at"), "v")
        ranked, n = positions(chosen, "__at", self.size)
        return SparkArray(ranked.select(F.col("pos").alias("i0"), "v"), (n,), self.dtype)

    def put(self, spec, value) -> SparkArray:
        """The array with the selected cells set, by a scalar or by an array of the selection's shape."""
        if isinstance(spec, SparkArray) and spec.dtype == "boolean":
            both, _ = self.paired(spec)
            return SparkArray(both.select(*self.index, F.when(F.col("w"), F.lit(value)).otherwise(F.col("v")).alias("v")), self.shape, self.dtype)
        tagged = SparkArray(self.df.select(*self.index, F.struct(*self.index).alias("v")), self.shape, self.dtype)[spec]
        cells = tagged.df.select(*tagged.index, *(F.col("v")[n].alias(f"__{n}") for n in self.index))
        if isinstance(value, SparkArray):
            new = value.broadcast_to(tagged.shape).df.withColumnRenamed("v", "__new")
            cells = cells.join(new, tagged.index) if tagged.index else cells.crossJoin(new)
        else:
            cells = cells.withColumn("__new", F.lit(value))
        cells = cells.select(*(F.col(f"__{n}").alias(n) for n in self.index), "__new", F.lit(True).alias("__hit"))
        after = self.df.join(cells, self.index, "left")
        kind = dtypes.SPARK[self.dtype][1]
        return SparkArray(after.select(*self.index, F.when(F.col("__hit"), F.col("__new").cast(kind)).otherwise(F.col("v")).alias("v")), self.shape, self.dtype)


def sum_all(flags: list[Column]) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & f
    return out


def axis_frame(spark: SparkSession, name: str, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))
