"""Shape algebra. Runs on the driver; touches no data."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

Shape = tuple[int, ...]


def size(shape: Sequence[int]) -> int:
    return math.prod(shape)


def c_strides(shape: Sequence[int]) -> Shape:
    return tuple(math.prod(shape[k + 1 :]) for k in range(len(shape)))


def axis_of(axis: int, rank: int) -> int:
    if not -rank <= axis < rank:
        raise ValueError(f"axis {axis} is beyond rank {rank}")
    return axis % rank


def axes_of(axis, rank: int) -> Shape:
    found = tuple(axis_of(a, rank) for a in ((axis,) if isinstance(axis, int) else range(rank) if axis is None else axis))
    if len(set(found)) < len(found):
        raise ValueError("an axis is named twice")
    return found


def broadcast_shapes(*shapes: Sequence[int]) -> Shape:
    out = []
    for dims in itertools.zip_longest(*(reversed(s) for s in shapes), fillvalue=1):
        wide = {d for d in dims if d != 1}
        if len(wide) > 1:
            raise ValueError(f"shapes {shapes} don't broadcast")
        out.append(wide.pop() if wide else 1)
    return tuple(reversed(out))


def broadcast_strides(a: Sequence[int], strides_a: Sequence[int], b: Sequence[int], strides_b: Sequence[int]) -> tuple[Shape, Shape, Shape]:
    """The common shape and both operands' strides in it; a stretched axis has stride 0."""
    shape = broadcast_shapes(a, b)

    def stretched(own: Sequence[int], strides: Sequence[int]) -> Shape:
        lead = len(shape) - len(own)
        return (0,) * lead + tuple(0 if d == 1 and shape[lead + k] != 1 else s for k, (d, s) in enumerate(zip(own, strides)))

    return shape, stretched(a, strides_a), stretched(b, strides_b)


def reshaped(old: Sequence[int], new: Sequence[int]) -> Shape:
    new = tuple(new)
    if new.count(-1) == 1:
        rest = -size(new)
        new = tuple(size(old) // rest if d == -1 else d for d in new) if rest else new
    if size(new) != size(old):
        raise ValueError(f"{tuple(old)} has no shape {new}")
    return new


@dataclass(frozen=True)
class Index:
    """One position; the axis goes."""

    value: int


@dataclass(frozen=True)
class Slice:
    start: int | None = None
    stop: int | None = None
    step: int = 1

    def __post_init__(self):
        if self.step == 0:
            raise ValueError("a slice's step is not 0")

    @staticmethod
    def all(step: int = 1) -> Slice:
        return Slice(None, None, step)

    def over(self, n: int) -> range:
        return range(*slice(self.start, self.stop, self.step).indices(n))


@dataclass(frozen=True)
class Indices:
    """Positions of one axis; with others, their outer product."""

    values: tuple[int, ...]

    def __init__(self, values):
        object.__setattr__(self, "values", tuple(values))


@dataclass(frozen=True)
class Mask:
    """The positions of one axis whose flag is true."""

    flags: tuple[bool, ...]

    def __init__(self, flags):
        object.__setattr__(self, "flags", tuple(bool(f) for f in flags))


class NewAxis:
    """A new axis of length 1."""


def selectors(spec, shape: Sequence[int]) -> list:
    """``spec`` as one selector for each axis, with NewAxis in between; an ellipsis fills up."""
    parts = list(spec) if isinstance(spec, (list, tuple)) else [spec]
    own = sum(p is not Ellipsis and p is not NewAxis and p is not None for p in parts)
    if own > len(shape):
        raise ValueError("more selectors than axes")
    if parts.count(Ellipsis) > 1:
        raise ValueError("one ellipsis at most")
    if Ellipsis not in parts:
        parts.append(Ellipsis)
    k = parts.index(Ellipsis)
    parts[k : k + 1] = [Slice()] * (len(shape) - own)
    out = []
    for p in parts:
        if isinstance(p, bool):
            raise TypeError("a boolean is no selector")
        if isinstance(p, int):
            p = Index(p)
        elif isinstance(p, slice):
            p = Slice(p.start, p.stop, 1 if p.step is None else p.step)
        elif isinstance(p, (list, tuple, range)):
            p = Mask(p) if p and all(isinstance(x, bool) for x in p) else Indices(p)
        out.append(NewAxis if p is None else p)
    return out
