"""Masked arrays: a masked cell is null, so Spark's own null rules do the masking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.array import SparkArray
from . import dtypes, ufuncs
from .ufuncs import col

#: What masked cells are filled with by default.
FILL = {"float": 1e20, "int": 999999, "uint": 999999, "bool": True}


def masked_invalid(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _unless(test: Callable[[Column, object], Column]):
    return lambda x, value: F.when(~F.coalesce(test(col(x), value), F.lit(False)), col(x))


masked_equal = _unless(lambda x, v: x == v)
masked_greater = _unless(lambda x, v: x > v)
masked_greater_equal = _unless(lambda x, v: x >= v)
masked_less = _unless(lambda x, v: x < v)
masked_less_equal = _unless(lambda x, v: x <= v)


def divide(a, b) -> Column:
    """A zero divisor is masked too."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / F.when(b != 0, b))


class MaskedArray:
    """A SparkArray whose null cells are masked, and a fill value."""

    def __init__(self, data: SparkArray, mask: SparkArray | None = None, fill_value=None):
        if mask is not None:
            data = data.binary(mask, lambda v, m: F.when(~m, v), data.dtype)
        self.data = data
        self.fill_value = FILL.get(dtypes.kind(data.dtype), 1e20) if fill_value is None else fill_value

    @property
    def shape(self):
        return self.data.shape

    @property
    def size(self):
        return self.data.size

    def _of(self, data: SparkArray) -> MaskedArray:
        return MaskedArray(data, fill_value=self.fill_value)

    @property
    def mask(self) -> SparkArray:
        return self.data.map(lambda v: v.isNull(), "boolean")

    def map_unary(self, f: Callable[[Column], Column]) -> MaskedArray:
        return self._of(self.data.map(f))

    def _binary(self, other, f) -> MaskedArray:
        return self._of(self.data.binary(other.data if isinstance(other, MaskedArray) else other, f))

    def add(self, other):
        return self._binary(other, ufuncs.add)

    def subtract(self, other):
        return self._binary(other, ufuncs.subtract)

    def multiply(self, other):
        return self._binary(other, ufuncs.multiply)

    def divide(self, other):
        return self._binary(other, divide)

    __add__, __sub__, __mul__, __truediv__ = add, subtract, multiply, divide

    def _reduce(self, how: Column, axis, dtype: str | None = None) -> MaskedArray:
        from ..operators.reductions import reduced

        return self._of(reduced(self.data, how, axis, dtype=dtype or self.data.dtype))

    def sum(self, axis=None):
        return self._reduce(F.sum("v"), axis)

    def prod(self, axis=None):
        return self._reduce(F.product("v"), axis)

    def min(self, axis=None):
        return self._reduce(F.min("v"), axis)

    def max(self, axis=None):
        return self._reduce(F.max("v"), axis)

    def mean(self, axis=None):
        return self._reduce(F.avg("v"), axis, "float64")

    def variance(self, axis=None):
        return self._reduce(F.var_pop("v"), axis, "float64")

    def std(self, axis=None):
        return self._reduce(F.stddev_pop("v"), axis, "float64")

    def count(self, axis=None):
        return self._reduce(F.count("v"), axis, "int32")

    def filled(self, value=None) -> SparkArray:
        return self.data.map(lambda v: F.coalesce(v, F.lit(self.fill_value if value is None else value)))

    def compressed(self) -> SparkArray:
        return self.data.apply_mask(self.data.map(lambda v: v.isNotNull(), "boolean"))

    def reshape(self, *shape):
        return self._of(self.data.reshape(*shape))

    def transpose(self, axes=None):
        return self._of(self.data.transpose(axes))

    def expand_dims(self, axis: int):
        return self._of(self.data.expand_dims(axis))

    def __getitem__(self, spec):
        return self._of(self.data[spec])

    def put(self, spec, value):
        """Cells set; None masks them."""
        return self._of(self.data.put(spec, value.data if isinstance(value, MaskedArray) else value))
