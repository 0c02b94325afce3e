"""Operators on whole rows or matrices, as Arrow batches through numpy.

For what has no relational form: transforms, decompositions, roots. A stack of
matrices is spread by its leading coordinates; one matrix is one task, so its
size is bounded by a worker's memory (``MATRIX_CELLS``), which is checked.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.array import SparkArray, names
from ..plans.shapes import axes_of, axis_of

MATRIX_CELLS = 1 << 26
COMPLEX = "struct<re:double,im:double>"


class LinAlgError(ValueError):
    """A matrix is singular, not positive definite or of the wrong shape."""


def _cells(values, is_complex: bool):
    return [{"re": float(z.real), "im": float(z.imag)} for z in values] if is_complex else values


def along_rows(a: SparkArray, f: Callable[[np.ndarray], np.ndarray], width: int, out_complex: bool, axis: int = -1, whole: bool = False) -> SparkArray:
    """``f`` on every vector along an axis: one group by the other coordinates, then vectorised batches.

    A vector is one row, so its length is checked; ``whole`` keeps 64-bit integers.
    """
    axis = axis_of(axis, a.rank)
    if max(a.shape[axis], width) > MATRIX_CELLS:
        raise ValueError(f"a vector of {a.shape[axis]} cells doesn't fit one task")
    if axis != a.rank - 1:
        return along_rows(a.moveaxis(axis, -1), f, width, out_complex, whole=whole).moveaxis(-1, axis)
    packed, lead, n = a.packed_rows(), a.index[:-1], a.shape[-1]
    is_complex = a.dtype.startswith("complex")

    def run(frames):
        for frame in frames:
            rows = [np.array([complex(c["re"], c["im"]) for c in v]) if is_complex else np.asarray(v, np.int64 if whole else float) for v in frame["v"]]
            out = f(np.stack(rows) if rows else np.zeros((0, n)))
            frame["v"] = [_cells(r, out_complex) if out_complex else r for r in out]
            yield frame

    kind = COMPLEX if out_complex else "bigint" if whole else "double"
    schema = "".join(f"{c} bigint, " for c in lead) + f"v array<{kind}>"
    done = packed.mapInPandas(run, schema)
    cells = done.select(*lead, F.posexplode("v").alias("__p", "v")).select(*lead, F.col("__p").cast("bigint").alias(f"i{len(lead)}"), "v")
    return SparkArray(cells, (*a.shape[:-1], width), "complex128" if out_complex else "int64" if whole else "float64")


#: Running operators without a block scan, by numpy's accumulate.
ACCUMULATE = {
    "logaddexp": np.logaddexp, "logaddexp2": np.logaddexp2, "fmin": np.fmin, "fmax": np.fmax, "logicalAnd": np.logical_and, "logicalOr": np.logical_or, "logicalXor": np.logical_xor,
    "gcd": np.gcd, "lcm": np.lcm, "bitwiseAnd": np.bitwise_and, "bitwiseOr": np.bitwise_or, "bitwiseXor": np.bitwise_xor,
}


def accumulate(a: SparkArray, op: str, axis: int = 0) -> SparkArray:
    """The inclusive scan of a reducible operator along an axis; operators on integers keep them."""
    from .scans import cumulative

    simple = {"add": "sum", "multiply": "prod", "minimum": "min", "maximum": "max"}.get(op)
    if simple:
        return cumulative(a, simple, axis)
    f, whole = ACCUMULATE[op], op in ("gcd", "lcm", "bitwiseAnd", "bitwiseOr", "bitwiseXor")
    return along_rows(a, lambda x: f.accumulate(x, axis=1) if whole else f.accumulate(x, axis=1).astype(float), a.shape[axis], False, axis, whole)


def fft(a: SparkArray, n: int | None = None, axis: int = -1, ortho: bool = False) -> SparkArray:
    n = n or a.shape[axis]
    return along_rows(a, lambda x: np.fft.fft(x, n, norm="ortho" if ortho else None), n, True, axis)


def ifft(a: SparkArray, n: int | None = None, axis: int = -1, ortho: bool = False) -> SparkArray:
    n = n or a.shape[axis]
    return along_rows(a, lambda x: np.fft.ifft(x, n, norm="ortho" if ortho else None), n, True, axis)


def rfft(a: SparkArray, n: int | None = None, axis: int = -1) -> SparkArray:
    n = n or a.shape[axis]
    return along_rows(a, lambda x: np.fft.rfft(x, n), n // 2 + 1, True, axis)


def irfft(a: SparkArray, n: int | None = None, axis: int = -1) -> SparkArray:
    n = n or 2 * (a.shape[axis] - 1)
    return along_rows(a, lambda x: np.fft.irfft(x, n), n, False, axis)


def _over(a: SparkArray, s, axes, f) -> SparkArray:
    on = axes_of(axes, a.rank)
    for k, n in zip(on, s or [None] * len(on), strict=True):
        a = f(a, n, k)
    return a


def fftn(a: SparkArray, s=None, axes=None) -> SparkArray:
    return _over(a, s, axes, fft)


def ifftn(a: SparkArray, s=None, axes=None) -> SparkArray:
    return _over(a, s, axes, ifft)


def fft2(a: SparkArray, s=None, axes=(-2, -1)) -> SparkArray:
    return fftn(a, s, axes)


def ifft2(a: SparkArray, s=None, axes=(-2, -1)) -> SparkArray:
    return ifftn(a, s, axes)


def fftshift(a: SparkArray, axes=None) -> SparkArray:
    on = axes_of(axes, a.rank)
    return a.roll([a.shape[k] // 2 for k in on], on)


def ifftshift(a: SparkArray, axes=None) -> SparkArray:
    on = axes_of(axes, a.rank)
    return a.roll([-(a.shape[k] // 2) for k in on], on)


# matrices
def per_matrix(a: SparkArray, f: Callable[..., list[np.ndarray]], shapes: list[tuple[int, ...]], others: list[SparkArray] = (), complex_out: bool = False) -> list[SparkArray]:
    """``f`` on every matrix of a stack (and on those of ``others`` with the same leading coordinates)."""
    if math.prod(a.shape[-2:]) > MATRIX_CELLS:
        raise LinAlgError(f"a matrix of {a.shape[-2:]} doesn't fit one task")
    lead = [f"i{k}" for k in range(a.rank - 2)]

    dims = [a.shape[len(lead):], *(o.shape[len(lead):] for o in others)]
    kinds = [a.dtype.startswith("complex"), *(o.dtype.startswith("complex") for o in others)]
    most_in, most_out = max(map(len, dims)), max(map(len, shapes))

    # cells travel as columns of numbers: a frame of lists and structs takes many times their size
    def rows(x: SparkArray, k: int) -> DataFrame:
        at = [(F.col(f"i{len(lead) + j}") if j < len(dims[k]) else F.lit(0)).cast("bigint").alias(f"__p{j}") for j in range(most_in)]
        re, im = (F.col("v.re"), F.col("v.im")) if kinds[k] else (F.col("v"), F.lit(0.0))
        return x.df.select(*lead, F.lit(k).alias("__of"), *at, re.cast("double").alias("re"), im.cast("double").alias("im"))

    stack = rows(a, 0)
    for k, o in enumerate(others):
        stack = stack.union(rows(o, k + 1))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        given = []
        for k, (d, z) in enumerate(zip(dims, kinds)):
            own = group[group["__of"] == k]
            m = np.zeros(d, complex if z else float)
            m[tuple(own[f"__p{j}"].to_numpy(int) for j in range(len(d)))] = own["re"].to_numpy() + 1j * own["im"].to_numpy() if z else own["re"].to_numpy()
            given.append(m)
        out = []
        for k, r in enumerate(f(*given)):
            r = np.asarray(r)
            at = np.unravel_index(np.arange(r.size), r.shape) if r.ndim else ()
            z, zero = r.ravel(), np.zeros(r.size, int)
            place = {f"__p{j}": at[j] if j < r.ndim else zero for j in range(most_out)}
            out.append(pd.DataFrame({**{c: zero + int(group[c].iloc[0]) for c in lead}, "k": zero + k, **place, "re": z.real.astype(float), "im": z.imag.astype(float)}))
        return pd.concat(out)

    schema = "".join(f"{c} bigint, " for c in lead) + "k int, " + "".join(f"__p{j} bigint, " for j in range(most_out)) + "re double, im double"
    done = stack.withColumn("__one", F.lit(0)).groupBy("__one", *lead).applyInPandas(run, schema)
    re, im = (F.coalesce(c, F.lit(math.nan)) for c in ("re", "im"))  # Arrow takes the NaN of a frame for null
    results = []
    for k, s in enumerate(shapes):
        full = (*a.shape[: len(lead)], *s)
        v = F.struct(re.alias("re"), im.alias("im")) if complex_out else re
        cells = done.where(F.col("k") == k).select(*lead, *(F.col(f"__p{j}").alias(f"i{len(lead) + j}") for j in range(len(s))), v.alias("v"))
        results.append(SparkArray(cells.select(*names(len(full)), "v"), full, "complex128" if complex_out else "float64"))
    return results


def _checked(f):
    def run(*m):
        try:
            return f(*m)
        except np.linalg.LinAlgError as e:
            raise LinAlgError(str(e)) from e

    return run


def _square(a: SparkArray) -> int:
    if a.rank < 2 or a.shape[-1] != a.shape[-2]:
        raise LinAlgError("the matrix is not square")
    return a.shape[-1]


def inv(a):
    n = _square(a)
    return per_matrix(a, _checked(lambda m: [np.linalg.inv(m)]), [(n, n)], complex_out=a.dtype.startswith("complex"))[0]


def det(a):
    _square(a)
    return per_matrix(a, lambda m: [np.linalg.det(m)], [()])[0]


def slogdet(a):
    _square(a)
    return tuple(per_matrix(a, lambda m: list(np.linalg.slogdet(m)), [(), ()]))


def solve(a, b):
    _square(a)
    return per_matrix(a, _checked(lambda m, y: [np.linalg.solve(m, y)]), [b.shape[a.rank - 2 :]], [b])[0]


def eig(a):
    n = _square(a)
    return tuple(per_matrix(a, lambda m: list(np.linalg.eig(m)), [(n,), (n, n)], complex_out=True))


def eigvals(a):
    return per_matrix(a, lambda m: [np.linalg.eigvals(m)], [(_square(a),)], complex_out=True)[0]


def eigh(a, lower: bool = True):
    n = _square(a)
    return tuple(per_matrix(a, lambda m: list(np.linalg.eigh(m, "L" if lower else "U")), [(n,), (n, n)]))


def eigvalsh(a, lower: bool = True):
    return per_matrix(a, lambda m: [np.linalg.eigvalsh(m, "L" if lower else "U")], [(_square(a),)])[0]


def cholesky(a, upper: bool = False):
    n = _square(a)
    return per_matrix(a, _checked(lambda m: [np.linalg.cholesky(m).T if upper else np.linalg.cholesky(m)]), [(n, n)])[0]


def qr(a, complete: bool = False):
    m, n = a.shape[-2:]
    k = m if complete else min(m, n)
    return tuple(per_matrix(a, lambda x: list(np.linalg.qr(x, "complete" if complete else "reduced")), [(m, k), (k, n)]))


def svd(a, full: bool = False):
    m, n = a.shape[-2:]
    k = min(m, n)
    return tuple(per_matrix(a, lambda x: list(np.linalg.svd(x, full_matrices=full)), [(m, m if full else k), (k,), (n if full else k, n)]))


def singular_values(a):
    return per_matrix(a, lambda x: [np.linalg.svd(x, compute_uv=False)], [(min(a.shape[-2:]),)])[0]


def pinv(a, rcond: float | None = None):
    m, n = a.shape[-2:]
    return per_matrix(a, lambda x: [np.linalg.pinv(x, rcond=1e-15 if rcond is None else rcond)], [(n, m)])[0]


def matrix_rank(a):
    return per_matrix(a, lambda x: [float(np.linalg.matrix_rank(x))], [()])[0]


def cond(a):
    return per_matrix(a, lambda x: [np.linalg.cond(x)], [()])[0]


def lstsq(a, b, rcond: float | None = None):
    """Solution, residual sums (NaN where the rank is not full), rank and singular values."""
    m, n = a.shape[-2:]
    k = b.shape[a.rank - 1 :]

    def one(x, y):
        s, res, rank, sv = np.linalg.lstsq(x, y, rcond=rcond)
        return [s, res if res.size else np.full(k or (1,), np.nan), float(rank), sv]

    return tuple(per_matrix(a, one, [(n, *k), k or (1,), (), (min(m, n),)], [b]))


def _lu(m):
    n = len(m)
    p, l, u = np.arange(n), np.eye(n), m.astype(float).copy()
    for k in range(n):
        best = k + int(np.argmax(np.abs(u[k:, k])))
        if best != k:
            u[[k, best]], p[[k, best]] = u[[best, k]], p[[best, k]]
            l[[k, best], :k] = l[[best, k], :k]
        if u[k, k] != 0:
            l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    return np.eye(n)[:, p], l, np.triu(u)


def lu(a):
    """P, L, U with a = P L U."""
    n = _square(a)
    return tuple(per_matrix(a, lambda m: list(_lu(m)), [(n, n)] * 3))


def lu_solve(factors, b):
    """x of a x = b from the factors of ``lu``."""
    p, low, up = factors

    def one(m, lower, upper, y):
        return [np.linalg.solve(upper, np.linalg.solve(lower, m.T @ y))]

    return per_matrix(p, _checked(one), [b.shape[p.rank - 2 :]], [low, up, b])[0]


def _hessenberg(m):
    h, n = m.astype(complex if np.iscomplexobj(m) else float).copy(), len(m)
    q = np.eye(n, dtype=h.dtype)
    for k in range(n - 2):
        x = h[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size * (x[0] / abs(x[0]) if x[0] != 0 else 1)
        v = x / np.linalg.norm(x)
        h[k + 1 :] -= 2 * np.outer(v, v.conj() @ h[k + 1 :])
        h[:, k + 1 :] -= 2 * np.outer(h[:, k + 1 :] @ v, v.conj())
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v.conj())
        h[k + 2 :, k] = 0
    return h, q


def hessenberg(a):
    """H and Q with a = Q H Q^T."""
    n = _square(a)
    return tuple(per_matrix(a, lambda m: list(_hessenberg(m)), [(n, n)] * 2))


def _schur(m):
    """Complex Schur form by shifted QR steps with deflation."""
    h, z = _hessenberg(m.astype(complex))
    hi = len(h) - 1
    steps = 0
    while hi > 0 and steps < 300 * len(h):
        small = np.abs(np.diag(h, -1)) < 1e-15 * (np.abs(np.diag(h)[:-1]) + np.abs(np.diag(h)[1:]))
        h[np.flatnonzero(small) + 1, np.flatnonzero(small)] = 0
        while hi > 0 and h[hi, hi - 1] == 0:
            hi -= 1
        if hi == 0:
            break
        lo = hi
        while lo > 0 and h[lo, lo - 1] != 0:
            lo -= 1
        a, b, c, d = h[hi - 1 : hi + 1, hi - 1 : hi + 1].ravel()
        root = np.sqrt((a - d) ** 2 / 4 + b * c)
        mu = min((a + d) / 2 + root, (a + d) / 2 - root, key=lambda e: abs(e - d)) if steps % 11 else abs(h[hi, hi - 1])
        w = slice(lo, hi + 1)
        q, r = np.linalg.qr(h[w, w] - mu * np.eye(hi - lo + 1))
        h[w, w] = r @ q + mu * np.eye(hi - lo + 1)
        h[w, hi + 1 :] = q.conj().T @ h[w, hi + 1 :]
        h[:lo, w] = h[:lo, w] @ q
        z[:, w] = z[:, w] @ q
        steps += 1
    return np.triu(h), z


def schur(a):
    """T upper triangular and Z unitary, complex, with a = Z T Z^H."""
    n = _square(a)
    return tuple(per_matrix(a, lambda m: list(_schur(m)), [(n, n)] * 2, complex_out=True))


# roots and cash flows of packed rows
def _roots(kind: str):
    p = np.polynomial
    return {"standard": np.roots, "chebyshev": p.chebyshev.chebroots, "legendre": p.legendre.legroots, "hermite": p.hermite.hermroots, "laguerre": p.laguerre.lagroots}[kind]


def roots(rows: DataFrame, coefficients: str, kind: str = "standard", out: str = "roots") -> DataFrame:
    """``rows`` with the complex roots of each row's coefficients."""

    @F.pandas_udf(f"array<{COMPLEX}>")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda v: _cells(np.atleast_1d(_roots(kind)(np.asarray(v, float))).astype(complex), True))

    return rows.withColumn(out, run(coefficients))


def irr(rows: DataFrame, flows: str, out: str = "irr") -> DataFrame:
    """The internal rate of return of each row's flows; NaN where all flows have one sign."""

    def one(v) -> float:
        v = np.trim_zeros(np.asarray(v, float), "f")
        if not len(v) or (v >= 0).all() or (v <= 0).all():
            return math.nan
        r = np.roots(v[::-1])
        g = 1 / r[(abs(r.imag) < 1e-9) & (r.real != 0)].real - 1
        g = g[g > -1]
        return float(min(g, key=abs)) if len(g) else math.nan

    @F.pandas_udf("double")
    def run(c: pd.Series) -> pd.Series:
        return c.map(one)

    # Arrow takes the NaN of a frame for null
    return rows.withColumn(out, F.when(F.col(flows).isNotNull(), F.coalesce(run(flows), F.lit(math.nan))))
