"""Products: joins on shared coordinates and grouped sums."""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ufuncs
from ..plans.array import SparkArray, names, small
from ..plans.shapes import Shape, axis_of, broadcast_shapes, size


def _labels(text: str, ranks: list[int]) -> tuple[list[str], str]:
    """Operand and output labels; an ellipsis becomes upper-case labels of its own, counted from the right."""
    left, _, out = text.replace(" ", "").partition("->")
    terms = left.split(",")
    if len(terms) != len(ranks):
        raise ValueError("a term for each operand")
    extra = [r - len(t.replace("...", "")) if "..." in t else 0 for t, r in zip(terms, ranks)]
    if any(e < 0 for e in extra):
        raise ValueError("more labels than axes")
    wide = string.ascii_uppercase[: max(extra, default=0)]
    terms = [t.replace("...", wide[len(wide) - e :]) for t, e in zip(terms, extra)]
    for t, r in zip(terms, ranks):
        if len(t) != r:
            raise ValueError(f"{t} doesn't name {r} axes")
    every = "".join(terms)
    out = out.replace("...", wide) if "->" in text else wide + "".join(sorted(c for c in set(every) if every.count(c) == 1 and c not in wide))
    if set(out) - set(every) or len(set(out)) < len(out):
        raise ValueError("an output label is unknown or named twice")
    return terms, out


def einsum(subscripts: str, *arrays: SparkArray) -> SparkArray:
    """Labels are columns: repeated ones filter, shared ones join, those not in the output are summed.

    Operands are taken smallest first, preferring one that shares a label, and a
    label that nothing else needs is summed before the next join. Complex
    operands are multiplied and summed by their parts.
    """
    terms, out = _labels(subscripts, [a.rank for a in arrays])
    is_complex = any(a.dtype.startswith("complex") for a in arrays)
    times = ufuncs.complex_multiply if is_complex else lambda x, y: F.col(x) * F.col(y)
    total = ufuncs.complex(F.sum("v.re"), F.sum("v.im")) if is_complex else F.sum("v")
    dims: dict[str, int] = {}
    frames: list[tuple[DataFrame, set[str], int]] = []
    for a, t in zip(arrays, terms):
        df, cols, seen = a.df, [], {}
        for k, c in enumerate(t):
            if dims.setdefault(c, a.shape[k]) != a.shape[k]:
                raise ValueError(f"label {c} has two lengths")
            if c in seen:
                df = df.where(F.col(f"i{k}") == F.col(f"i{seen[c]}"))
            else:
                seen[c] = k
                cols.append(F.col(f"i{k}").alias(f"_{c}"))
        v = F.col("v") if a.dtype.startswith("complex") else ufuncs.complex("v") if is_complex else F.col("v").cast("double")
        frames.append((df.select(*cols, v.alias("v")), set(seen), a.size))
    frames.sort(key=lambda f: f[2])
    df, have, cells = frames.pop(0)
    while frames:
        k = next((k for k, f in enumerate(frames) if f[1] & have), 0)
        other, labels, n = frames.pop(k)
        shared = sorted(f"_{c}" for c in labels & have)
        right = other.withColumnRenamed("v", "w")
        left = small(df, (cells,))
        df = (left.join(small(right, (n,)), shared) if shared else left.crossJoin(small(right, (n,)))).withColumn("v", times("v", "w")).drop("w")
        have |= labels
        needed = set(out).union(*(f[1] for f in frames))
        if have - needed:
            have &= needed
            df = df.groupBy(*(f"_{c}" for c in sorted(have))).agg(total.alias("v"))
        cells = size([dims[c] for c in have])
    if have - set(out):
        df = df.groupBy(*(f"_{c}" for c in out)).agg(total.alias("v"))
    cells = df.select(*(F.col(f"_{c}").alias(n) for c, n in zip(out, names(len(out)))), "v")
    return SparkArray(cells, [dims[c] for c in out], "complex128" if is_complex else "float64")


def tensordot(a: SparkArray, b: SparkArray, axes: int | tuple[Sequence[int], Sequence[int]] = 2) -> SparkArray:
    on = (range(a.rank - axes, a.rank), range(axes)) if isinstance(axes, int) else axes
    left, right = list(string.ascii_lowercase[: a.rank]), list(string.ascii_lowercase[a.rank : a.rank + b.rank])
    for x, y in zip(*on, strict=True):
        right[axis_of(y, b.rank)] = left[axis_of(x, a.rank)]
    free = [c for c in left if c not in right] + [c for c in right if c not in left]
    return einsum(f"{''.join(left)},{''.join(right)}->{''.join(free)}", a, b)


#: Cells of a product, and of what a task multiplies at once, where matrices are multiplied by blocks of the shared axis.
PRODUCT_CELLS, BLOCK_CELLS = 1 << 16, 1 << 20


def _by_blocks(a: SparkArray, b: SparkArray) -> SparkArray:
    """The product of a wide and a tall matrix: a partial product for each block of the shared axis, then their sum.

    Cells are shuffled once; no pair of them is joined.
    """
    n, m = a.shape[0], b.shape[1]
    width = max(1, BLOCK_CELLS // max(1, n + m))
    left = a.df.select(F.floor(F.col("i1") / width).alias("block"), F.lit(True).alias("left"), F.col("i0").alias("at"), F.col("i1").alias("k"), "v")
    right = b.df.select(F.floor(F.col("i0") / width).alias("block"), F.lit(False).alias("left"), F.col("i1").alias("at"), F.col("i0").alias("k"), "v")

    def product(group: pa.Table) -> pa.Table:
        own, at, k, v = (group[c].to_numpy() for c in ("left", "at", "k", "v"))
        own, k = own.astype(bool), k % width
        x, y = np.zeros((n, width)), np.zeros((width, m))
        x[at[own], k[own]], y[k[~own], at[~own]] = v[own], v[~own]
        cells = (x @ y).ravel()
        row, column = np.divmod(np.arange(n * m), max(m, 1))
        return pa.table({"i0": row, "i1": column, "v": cells})

    parts = left.union(right).groupBy("block").applyInArrow(product, "i0 bigint, i1 bigint, v double")
    return SparkArray(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (n, m))


def matmul(a: SparkArray, b: SparkArray) -> SparkArray:
    if not a.rank or not b.rank:
        raise ValueError("a matrix product takes no scalars")
    x, y = "k" if a.rank == 1 else "ik", "k" if b.rank == 1 else "kj"
    out = x.replace("k", "") + y.replace("k", "")
    if a.rank == b.rank == 2 and a.shape[1] == b.shape[0] and a.shape[0] * b.shape[1] <= PRODUCT_CELLS and a.dtype == b.dtype == "float64":
        return _by_blocks(a, b)
    if a.rank <= 2 and b.rank <= 2:
        return einsum(f"{x},{y}->{out}", a, b)
    lead = broadcast_shapes(a.shape[:-2], b.shape[:-2])
    a, b = (m.broadcast_to((*lead, *m.shape[-2:])) if m.rank > 2 and m.shape[:-2] != lead else m for m in (a, b))
    return einsum(f"{'...' if a.rank > 2 else ''}{x},{'...' if b.rank > 2 else ''}{y}->...{out}", a, b)


dot = matmul


def chain_order(shapes: list[Shape]) -> list[list[int]]:
    """Where to cut each run of a matrix chain, by dynamic programming over the products' cost."""
    p = [shapes[0][0], *(s[1] for s in shapes)]
    n = len(shapes)
    cost, cut = [[0] * n for _ in range(n)], [[0] * n for _ in range(n)]
    for length in range(1, n):
        for i in range(n - length):
            j = i + length
            cost[i][j], cut[i][j] = min((cost[i][k] + cost[k + 1][j] + p[i] * p[k + 1] * p[j + 1], k) for k in range(i, j))
    return cut


def multi_dot(arrays: list[SparkArray]) -> SparkArray:
    if len(arrays) == 1:
        return arrays[0]
    first, last = arrays[0].rank == 1, arrays[-1].rank == 1
    m = [a.reshape(1, -1) if k == 0 and first else a.reshape(-1, 1) if k == len(arrays) - 1 and last else a for k, a in enumerate(arrays)]
    cut = chain_order([a.shape for a in m])

    def product(i: int, j: int) -> SparkArray:
        return m[i] if i == j else matmul(product(i, cut[i][j]), product(cut[i][j] + 1, j))

    out = product(0, len(m) - 1)
    return out.squeeze([k for k, gone in enumerate((first, last)) if gone]) if first or last else out


def matrix_power(a: SparkArray, n: int) -> SparkArray:
    from .kernels import inv
    from .shaping import eye

    if a.rank != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("the matrix is not square")
    if n < 0:
        return matrix_power(inv(a), -n)
    out = None
    while n:
        if n & 1:
            out = a if out is None else matmul(out, a)
        n >>= 1
        if n:
            a = matmul(a, a)
    return eye(a.spark, a.shape[0]) if out is None else out


def outer(a: SparkArray, b: SparkArray, op: str = "multiply") -> SparkArray:
    """Any binary operator on every pair of cells: as many cells as asked for, by broadcasting the smaller side."""
    right = small(b.df.select(*(F.col(c).alias(f"i{a.rank + k}") for k, c in enumerate(b.index)), F.col("v").alias("w")), b.shape)
    shape = (*a.shape, *b.shape)
    dtype = "boolean" if op in ("equal", "notEqual", "greater", "greaterEqual", "less", "lessEqual") else "float64"
    return SparkArray(a.df.crossJoin(right).select(*names(len(shape)), ufuncs.BINARY[op]("v", "w").alias("v")), shape, dtype)


def inner(a: SparkArray, b: SparkArray) -> SparkArray:
    return tensordot(a, b, ([a.rank - 1], [b.rank - 1]))


def vdot(a: SparkArray, b: SparkArray) -> SparkArray:
    x, y = a.flatten(), b.flatten()
    if a.dtype.startswith("complex"):
        both, _ = x.paired(y)
        z = ufuncs.complex_multiply(ufuncs.conj("v"), F.col("w"))
        return SparkArray(both.select(z.alias("z")).agg(ufuncs.complex(F.sum("z.re"), F.sum("z.im")).alias("v")), (), "complex128")
    return einsum("i,i->", x, y)


def kron(a: SparkArray, b: SparkArray) -> SparkArray:
    rank = max(a.rank, b.rank)
    a, b = (m.reshape((*(1,) * (rank - m.rank), *m.shape)) for m in (a, b))
    pairs = outer(a, b)
    new = [(F.col(f"i{k}") * b.shape[k] + F.col(f"i{rank + k}")).alias(f"i{k}") for k in range(rank)]
    return SparkArray(pairs.df.select(*new, "v"), [x * y for x, y in zip(a.shape, b.shape)])


def cross(a: SparkArray, b: SparkArray, axis: int = -1) -> SparkArray:
    """Of vectors of length 3 along an axis; of length 2, the one component that is left."""
    axis = axis_of(axis, a.rank)
    x, y = a.moveaxis(axis, -1), b.moveaxis(axis, -1)
    both, shape = x.paired(y)
    lead, n = names(len(shape) - 1), shape[-1]
    if n not in (2, 3):
        raise ValueError("vectors have 2 or 3 components")
    at = lambda c, k: F.max(F.when(F.col(f"i{len(lead)}") == k, F.col(c)))
    rows = both.groupBy(*lead).agg(*(at(c, k).alias(f"{c}{k}") for c in "vw" for k in range(n)))
    minor = lambda i, j: F.col(f"v{i}") * F.col(f"w{j}") - F.col(f"v{j}") * F.col(f"w{i}")
    if n == 2:
        return SparkArray(rows.select(*lead, minor(0, 1).alias("v")), shape[:-1])
    cells = rows.select(*lead, F.posexplode(F.array(minor(1, 2), minor(2, 0), minor(0, 1))).alias("__k", "v"))
    return SparkArray(cells.select(*lead, F.col("__k").cast("bigint").alias(f"i{len(lead)}"), "v"), shape).moveaxis(-1, axis)


def _distance(metric: str, u, v):
    def total(f):
        return F.aggregate(F.zip_with(u, v, f), F.lit(0.0), lambda s, x: s + x)

    if metric == "euclidean":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "chebyshev":
        return F.coalesce(F.array_max(F.zip_with(u, v, lambda x, y: F.abs(x - y))), F.lit(0.0))
    if metric == "hamming":
        return ufuncs.divide(total(lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), F.size(u))
    if metric == "cosine":
        square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
        return 1 - ufuncs.divide(total(lambda x, y: x * y), F.sqrt(square(u)) * F.sqrt(square(v)))
    raise ValueError(f"unknown metric {metric}")


def cdist(a: SparkArray, b: SparkArray, metric: str = "euclidean") -> SparkArray:
    """Every distance between the rows of two matrices; rows are packed once, the smaller matrix is broadcast."""
    x = a.astype("float64").packed_rows()
    y = small(b.astype("float64").packed_rows().select(F.col("i0").alias("i1"), F.col("v").alias("w")), b.shape)
    return SparkArray(x.crossJoin(y).select("i0", "i1", _distance(metric, F.col("v"), F.col("w")).alias("v")), (a.shape[0], b.shape[0]))


def pdist(a: SparkArray, metric: str = "euclidean") -> SparkArray:
    """The distances of rows i < j, in the condensed order."""
    m = a.shape[0]
    d = cdist(a, a, metric).df.where("i0 < i1")
    at = F.lit(m) * F.col("i0") - F.floor(F.col("i0") * (F.col("i0") + 1) / 2) + F.col("i1") - F.col("i0") - 1
    return SparkArray(d.select(at.cast("bigint").alias("i0"), "v"), (m * (m - 1) // 2,))


# convolution: the kernel is the operand that is spread
def convolve(a: SparkArray, b: SparkArray, mode: str = "full") -> SparkArray:
    if a.rank != b.rank or mode not in ("full", "valid", "same"):
        raise ValueError("equal ranks; full, valid or same")
    if a.rank == 1 and 0 < b.size <= KERNEL and a.size and a.dtype == b.dtype == "float64":
        return _cut(_along_line(a, b), a, b, mode)
    right = small(b.df.select(*(F.col(c).alias(f"j{k}") for k, c in enumerate(b.index)), F.col("v").alias("w")), b.shape)
    at = [(F.col(f"i{k}") + F.col(f"j{k}")).alias(f"i{k}") for k in range(a.rank)]
    full = a.df.crossJoin(right).select(*at, (F.col("v") * F.col("w")).alias("v")).groupBy(*a.index).agg(F.sum("v").alias("v"))
    return _cut(SparkArray(full, [x + y - 1 for x, y in zip(a.shape, b.shape)]), a, b, mode)


#: Cells of a kernel that every block of a line is convolved with, and of a block.
KERNEL, LINE = 1 << 16, 1 << 17


def _along_line(a: SparkArray, b: SparkArray) -> SparkArray:
    """The full convolution of a vector, block by block: a block takes the last cells of the one before, as many as the kernel reaches."""
    n, m = a.size, b.size
    reach = F.array_distinct(F.array(F.floor(F.col("i0") / LINE), F.floor((F.col("i0") + m - 1) / LINE)))
    blocks = a.df.select(F.explode(reach).alias("block"), "i0", "v").groupBy("block").agg(F.collect_list(F.struct("i0", "v")).alias("cells"))
    kernel = b.df.agg(F.transform(F.sort_array(F.collect_list(F.struct("i0", "v"))), lambda c: c["v"]).alias("kernel"))

    def run(batches):
        for batch in batches:
            for block, cells, weights in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * LINE - (m - 1)
                x = np.zeros(LINE + m - 1)
                for c in cells:
                    x[c["i0"] - first] = c["v"]
                y = np.convolve(x, weights, "valid")[: n + m - 1 - block * LINE]
                yield pa.RecordBatch.from_pydict({"i0": block * LINE + np.arange(len(y)), "v": y})

    return SparkArray(blocks.crossJoin(F.broadcast(kernel)).mapInArrow(run, "i0 bigint, v double"), (n + m - 1,))  # one row


def _cut(whole: SparkArray, a: SparkArray, b: SparkArray, mode: str) -> SparkArray:
    if mode == "full":
        return whole
    if mode == "same":
        cut = [((y - 1) // 2, x) for x, y in zip(a.shape, b.shape)]
    else:
        cut = [(min(x, y) - 1, max(x, y) - min(x, y) + 1) for x, y in zip(a.shape, b.shape)]
    return whole[[slice(s, s + n) for s, n in cut]]


def correlate(a: SparkArray, b: SparkArray, mode: str = "valid") -> SparkArray:
    return convolve(a, b.flip(), mode)


convolve2d = convolve
