import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import dtypes, masked, ufuncs
from tesserine.operators import contractions as con
from tesserine.operators import kernels as ker
from tesserine.operators import optimize, ordering, polynomials, random, scans, shaping
from tesserine.operators import reductions as red
from tesserine.plans.array import SparkArray
from tesserine.plans.shapes import Index, Indices, Mask, NewAxis, Slice, broadcast_shapes, broadcast_strides, reshaped

R = np.random.default_rng(3)
A = R.normal(size=(4, 6)).round(3)
T = R.normal(size=(2, 3, 4)).round(3)


@pytest.fixture(scope="module")
def a(spark):
    return SparkArray.of(spark, A)


@pytest.fixture(scope="module")
def t(spark):
    return SparkArray.of(spark, T)


def vec(spark, values, dtype=None):
    return SparkArray.of(spark, np.array(values, dtype=None if dtype is None else dtype))


def same(got, want, tol=1e-9):
    got = got.numpy() if isinstance(got, SparkArray) else got
    want = np.asarray(want)
    assert got.shape == want.shape
    assert np.allclose(got.astype(complex), want.astype(complex), rtol=tol, atol=tol, equal_nan=True)


def test_shape_algebra():
    assert broadcast_shapes((3, 1), (4,)) == (3, 4)
    assert broadcast_strides((3, 1), (1, 1), (4,), (1,)) == ((3, 4), (1, 0), (0, 1))
    assert reshaped((4, 6), (-1, 8)) == (3, 8)
    for bad in (lambda: broadcast_shapes((3,), (4,)), lambda: reshaped((4,), (3,)), lambda: Slice(step=0)):
        with pytest.raises(ValueError):
            bad()


def test_promotion():
    assert dtypes.promote("boolean", "boolean") == "uint8" and dtypes.promote_device("boolean", "boolean") == "boolean"
    assert dtypes.promote("float32", "int32") == "float64" and dtypes.promote_device("float32", "int32") == "float32"
    assert dtypes.promote("float32", "int16") == "float32" and dtypes.promote("float16", "bfloat16") == "float32"
    assert dtypes.promote("uint64", "int64") == "float64" and dtypes.promote("uint8", "int8") == "int16" and dtypes.promote("uint32", "int64") == "int64"
    assert dtypes.promote("complex64", "float64") == "complex128" and dtypes.promote("complex64", "int32") == "complex64"
    for x in dtypes.SPARK:
        for y in dtypes.SPARK:
            assert dtypes.promote(x, y) == dtypes.promote(y, x)


@pytest.mark.parametrize("spec", [(0,), (slice(1, 4, 2),), (slice(None), slice(None, None, -1)), (Ellipsis, 2), (slice(-1, None, -2), slice(-3, None)), (NewAxis, 1), (slice(3, 1),)])
def test_slices(a, spec):
    same(a[list(spec)], A[tuple(None if s is NewAxis else s for s in spec)])


def test_selectors(a):
    same(a[[Indices([2, 0, 0]), Mask([True, False, True, False, False, True])]], A[np.ix_([2, 0, 0], [0, 2, 5])])
    same(a[[Index(-1)]], A[-1])
    same(a[a > 0], A[A > 0])
    with pytest.raises(IndexError):
        a[[Index(9)]]


def test_put(a):
    b = A.copy()
    b[1:3, ::2] = 7
    same(a.put([slice(1, 3), slice(None, None, 2)], 7.0), b)
    same(a.put(a > 1, 0.0), np.where(A > 1, 0, A))


@pytest.mark.parametrize("f, g", [
    (lambda x: x.transpose(), lambda x: x.T), (lambda x: x.reshape(3, 8), lambda x: x.reshape(3, 8)), (lambda x: x.flatten(), np.ravel), (lambda x: x.flip(0), lambda x: np.flip(x, 0)),
    (lambda x: x.roll(2, 1), lambda x: np.roll(x, 2, 1)), (lambda x: x.roll(3), lambda x: np.roll(x, 3)), (lambda x: x.rot90(), np.rot90), (lambda x: x.rot90(3), lambda x: np.rot90(x, 3)), (lambda x: x.rot90(2), lambda x: np.rot90(x, 2)),
    (lambda x: x.expand_dims(1).squeeze(1), lambda x: x), (lambda x: shaping.tril(x, -1), lambda x: np.tril(x, -1)), (lambda x: shaping.triu(x, 1), lambda x: np.triu(x, 1)), (lambda x: shaping.diagonal(x, 1), lambda x: np.diagonal(x, 1)), (lambda x: shaping.diag(x[0], -1), lambda x: np.diag(x[0], -1)),
    (lambda x: shaping.tile(x, [2, 1]), lambda x: np.tile(x, (2, 1))), (lambda x: shaping.repeat(x, 2, 1), lambda x: np.repeat(x, 2, 1)), (lambda x: shaping.repeat(x, [1, 0, 2, 1], 0), lambda x: np.repeat(x, [1, 0, 2, 1], 0)),
    (lambda x: shaping.concatenate([x, x], 1), lambda x: np.concatenate([x, x], 1)), (lambda x: shaping.stack([x, x], 1), lambda x: np.stack([x, x], 1)), (lambda x: shaping.hstack([x[0], x[1]]), lambda x: np.hstack([x[0], x[1]])), (lambda x: shaping.vstack([x[0], x[1]]), lambda x: np.vstack([x[0], x[1]])),
    (lambda x: shaping.dstack([x, x]), lambda x: np.dstack([x, x])), (lambda x: shaping.column_stack([x[:, 0], x[:, 1]]), lambda x: np.column_stack([x[:, 0], x[:, 1]])), (lambda x: shaping.array_split(x, 4, 1)[1], lambda x: np.array_split(x, 4, 1)[1]), (lambda x: shaping.hsplit(x, 3)[2], lambda x: np.hsplit(x, 3)[2]),
    (lambda x: shaping.as_strided(x, (3, 2), (1, 6)), lambda x: np.lib.stride_tricks.as_strided(x, (3, 2), (8, 48))), (lambda x: scans.diff(x, 2, 1), lambda x: np.diff(x, 2, 1)), (lambda x: scans.cumulative(x, "sum", 0), lambda x: np.cumsum(x, 0)), (lambda x: scans.cumulative(x, "prod"), np.cumprod), (lambda x: scans.cumulative(x, "max", 1), lambda x: np.maximum.accumulate(x, 1)),
    (lambda x: scans.gradient(x, 0.5, 1, 2), lambda x: np.gradient(x, 0.5, axis=1, edge_order=2)), (lambda x: scans.trapz(x, 2.0), lambda x: np.trapezoid(x, dx=2.0)), (lambda x: scans.unwrap(x.map(lambda v: v * 5)), lambda x: np.unwrap(x * 5)), (lambda x: scans.sliding_windows(x, 3, 1), lambda x: np.lib.stride_tricks.sliding_window_view(x, 3, 1)),
    (lambda x: ordering.sort(x), lambda x: np.sort(x)), (lambda x: ordering.sort(x.flatten()), lambda x: np.sort(x.ravel())), (lambda x: ordering.argsort(x, 0), lambda x: np.argsort(x, 0)), (lambda x: ordering.argwhere((x > 0).astype("int64")), lambda x: np.argwhere(x > 0)), (lambda x: ordering.take_along_axis(x, ordering.argsort(x, 1), 1), np.sort),
    (lambda x: red.reduce(x, "sum", 0), lambda x: x.sum(0)), (lambda x: red.reduce(x, "std", 1, True), lambda x: x.std(1, keepdims=True)), (lambda x: red.reduce(x, "variance", ddof=1), lambda x: x.var(ddof=1)), (lambda x: red.reduce(x, "ptp", 1), lambda x: np.ptp(x, 1)), (lambda x: red.arg_reduce(x, "argmin", 0), lambda x: x.argmin(0)), (lambda x: red.arg_reduce(x, "argmax"), lambda x: x.argmax()),
    (lambda x: red.cov(x), np.cov), (lambda x: red.corrcoef(x), np.corrcoef), (lambda x: red.norm(x, 1, 0), lambda x: np.linalg.norm(x, 1, 0)), (lambda x: red.norm(x, math.inf), lambda x: np.linalg.norm(x, math.inf)), (lambda x: red.norm(x, 2), lambda x: np.linalg.norm(x, 2)), (lambda x: red.reduce(x, "logaddexp", 0), lambda x: np.logaddexp.reduce(x, 0)),
    (lambda x: con.matmul(x, x.transpose()), lambda x: x @ x.T), (lambda x: con.einsum("ij,kj->ik", x, x), lambda x: x @ x.T), (lambda x: con.einsum("ij->", x), lambda x: x.sum()), (lambda x: con.kron(x[:2, :2], x[:, :2]), lambda x: np.kron(x[:2, :2], x[:, :2])), (lambda x: con.outer(x[0], x[1], "add"), lambda x: np.add.outer(x[0], x[1])), (lambda x: con.vdot(x, x), lambda x: np.vdot(x, x)),
    (lambda x: con.inner(x, x), lambda x: np.inner(x, x)), (lambda x: con.cross(x[:, :3], x[:, 3:]), lambda x: np.cross(x[:, :3], x[:, 3:])), (lambda x: con.multi_dot([x, x.transpose(), x]), lambda x: np.linalg.multi_dot([x, x.T, x])), (lambda x: con.matrix_power(x[:, :4], -2), lambda x: np.linalg.matrix_power(x[:, :4], -2)), (lambda x: con.convolve(x[0], x[1]), lambda x: np.convolve(x[0], x[1])), (lambda x: con.convolve(x[0], x[1, :3], "same"), lambda x: np.convolve(x[0], x[1, :3], "same")), (lambda x: con.correlate(x[0], x[1, :3]), lambda x: np.correlate(x[0], x[1, :3])),
    (lambda x: ker.accumulate(x, "logaddexp", 1), lambda x: np.logaddexp.accumulate(x, 1)), (lambda x: ker.lu_solve(ker.lu(x[:, :4]), x[:, 4:]), lambda x: np.linalg.solve(x[:, :4], x[:, 4:])), (lambda x: ker.fft(x), np.fft.fft), (lambda x: ker.ifft(ker.fft(x)), lambda x: x), (lambda x: ker.rfft(x, 8), lambda x: np.fft.rfft(x, 8)), (lambda x: ker.irfft(ker.rfft(x)), lambda x: x), (lambda x: ker.fft2(x), np.fft.fft2), (lambda x: ker.ifftshift(ker.fftshift(x)), lambda x: x), (lambda x: ker.fft(x, None, 0), lambda x: np.fft.fft(x, axis=0)),
    (lambda x: ker.inv(x[:, :4]), lambda x: np.linalg.inv(x[:, :4])), (lambda x: ker.det(x[:, :4]), lambda x: np.linalg.det(x[:, :4])), (lambda x: ker.solve(x[:, :4], x[:, 4:]), lambda x: np.linalg.solve(x[:, :4], x[:, 4:])), (lambda x: ker.pinv(x), np.linalg.pinv), (lambda x: ker.singular_values(x), lambda x: np.linalg.svd(x, compute_uv=False)),
])
def test_against_numpy(a, f, g):
    same(f(a), g(A))


@pytest.mark.parametrize("mode", ["edge", "reflect", "symmetric", "wrap", "mean", "median", "min", "max", "constant", "linearRamp"])
def test_pad(a, mode):
    same(shaping.pad(a, [(2, 1), (0, 3)], mode), np.pad(A, [(2, 1), (0, 3)], {"linearRamp": "linear_ramp", "min": "minimum", "max": "maximum"}.get(mode, mode)))


def test_stacks(t):
    same(t.moveaxis(0, 2), np.moveaxis(T, 0, 2))
    same(t.swapaxes(0, 2), T.swapaxes(0, 2))
    same(con.tensordot(t, t, ([1, 2], [1, 2])), np.tensordot(T, T, ([1, 2], [1, 2])))
    same(con.einsum("...ij->...ji", t), np.einsum("...ij->...ji", T))
    same(con.matmul(t, t.transpose([0, 2, 1])), T @ T.transpose(0, 2, 1))
    same(red.reduce(t, "mean", (0, 2)), T.mean((0, 2)))
    same(t + red.reduce(t, "sum", 1, True), T + T.sum(1, keepdims=True))
    same(ker.det(t[:, :, :3]), np.linalg.det(T[:, :, :3]))


def test_decompositions(spark):
    m = R.normal(size=(5, 5))
    x = SparkArray.of(spark, m)
    p, low, up = (r.numpy() for r in ker.lu(x))
    assert np.allclose(p @ low @ up, m)
    h, q = (r.numpy() for r in ker.hessenberg(x))
    assert np.allclose(q @ h @ q.T, m) and np.allclose(np.tril(h, -2), 0)
    s, z = (r.numpy() for r in ker.schur(x))
    assert np.allclose(z @ s @ z.conj().T, m) and np.allclose(np.tril(s, -1), 0)
    w, v = (r.numpy() for r in ker.eig(x))
    assert np.allclose(m @ v, v * w)
    with pytest.raises(ValueError):
        ker.inv(x[:3])


def test_fixtures(spark):
    v = lambda x: spark.createDataFrame([(k, float(y)) for k, y in enumerate(x)], "i0 long, v double")
    h = lambda *a, **k: [r.v for r in ordering.histogram(*a, **k).orderBy("bin").collect()]
    assert h(v([1, 2, 1]), "v", 2) == [2, 1] and h(v([0.5, 0.5, 1.5, 2.5, 3.5]), "v", [0, 1, 2, 3, 4]) == [2, 1, 1, 1]
    assert h(v([1, 2, 3, 4]), "v", 2, (1.5, 3.5)) == [1, 1] and h(v([]), "v", 3) == [0, 0, 0]
    assert h(v([1, 2, 1]).withColumn("w", F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), (F.col("i0") + 1).cast("int"))), "v", 2, weights="w") == [2.5, 1.0]
    x = [0.2, 6.4, 3.0, 1.6, -1, 11]
    got = v(x).select("i0", ordering.in_edges(F.col("v"), [0, 1, 2.5, 4, 10]).alias("d")).orderBy("i0").collect()
    assert [r.d for r in got] == [1, 4, 3, 2, 0, 5]
    nan = [1, math.nan, 3, 4, math.nan, 6]
    row = v(nan).agg(red.agg_nanvar().alias("a"), red.agg_nanmin().alias("b"), red.agg_nanmax().alias("c"), red.agg_min().alias("d"), red.agg_median().alias("e")).head()
    assert (row.a, row.b, row.c) == (3.25, 1, 6) and math.isnan(row.d) and math.isnan(row.e)
    q = lambda p, m: red.quantile(v([10, 20, 30, 40]), "v", p, m).head()["v"]
    assert [q(0.35, "invertedCdf"), q(0.5, "invertedCdf"), q(0.35, "averagedInvertedCdf"), q(0.5, "averagedInvertedCdf")] == [20, 20, 20, 25]
    for m, n in (("hazen", "hazen"), ("weibull", "weibull"), ("linear", "linear"), ("medianUnbiased", "median_unbiased"), ("normalUnbiased", "normal_unbiased"), ("lower", "lower"), ("higher", "higher"), ("midpoint", "midpoint"), ("nearest", "nearest"), ("interpolatedInvertedCdf", "interpolated_inverted_cdf"), ("closestObservation", "closest_observation")):
        for p in (0.0, 0.1, 0.375, 0.5, 0.8, 1.0):
            assert math.isclose(q(p, m), np.quantile([10.0, 20, 30, 40], p, method=n)), (m, p)
    u = ordering.unique(vec(spark, [3.0, 1, 2, 1, math.nan, 2, math.nan]))
    same(u["values"], [1, 2, 3, math.nan])
    assert u["counts"].to_list() == [2, 2, 1, 2] and u["inverse"].to_list() == [2, 0, 1, 0, 3, 1, 3]
    for side, want in (("left", [2, 2, 5]), ("right", [2, 3, 5])):
        assert [r["at"] for r in ordering.searchsorted(v([1, 2, 3, 4, 5]), v([2.5, 3, 5.5]), side=side).orderBy("i0").collect()] == want
    assert scans.trapz(vec(spark, [1.0, 2, 4]), vec(spark, [0.0, 2, 3])).item() == 6
    masked_root = v([4, 9, 16, 25]).select("i0", ufuncs.sqrt("v", where=F.col("i0") % 2 == 0, out=F.lit(100.0)).alias("v")).orderBy("i0").collect()
    assert [r.v for r in masked_root] == [2, 100, 4, 100]
    same(con.pdist(vec(spark, [[1.0, 2], [3, 4], [5, 6]])), [8**0.5, 32**0.5, 8**0.5])
    flows = spark.createDataFrame([(0, [-100.0, 39.0, 59.0, 55.0, 20.0]), (1, [-100.0, 0.0, 0.0, 74.0]), (2, [1.0, 2.0])], "id long, c array<double>")
    r = [x.irr for x in ker.irr(flows, "c").orderBy("id").collect()]
    assert abs(r[0] - 0.28095) < 1e-5 and abs(r[1] + 0.0955) < 1e-4 and math.isnan(r[2])
    assert red.reduceat(vec(spark, [1.0, 2, 3, 4]), [0, 2, 1], "add").to_list() == [3, 3, 9]
    assert red.at(vec(spark, [1.0, 2, 3]), vec(spark, [0, 0, 2]), vec(spark, [1.0, 1, 5]), "add").to_list() == [3, 2, 8]


def test_interp_and_bins(spark):
    q = spark.createDataFrame([(k, float(x)) for k, x in enumerate([-1, 0, 0.4, 1.5, 3, 9])] + [(6, math.nan)], "k long, x double")
    knots = spark.createDataFrame([(0.0, 10.0), (1.0, 20.0), (3.0, 0.0)], "xp double, fp double")
    got = [r.v for r in ordering.interp(q, knots).orderBy("k").collect()]
    assert np.allclose(got[:6], np.interp([-1, 0, 0.4, 1.5, 3, 9], [0, 1, 3], [10, 20, 0])) and math.isnan(got[6])
    assert [r.v for r in ordering.interp(q, knots, method="nearest", left=-1.0).orderBy("k").collect()][:4] == [-1, 10, 10, 20]
    counted = ordering.bincount(spark.createDataFrame([(0,), (3,), (3,)], "x long"), "x", least=6).orderBy("bin").collect()
    assert [r.v for r in counted] == [1, 0, 0, 2, 0, 0]


def test_scan_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 7)
    x = R.normal(size=400)
    v = SparkArray.of(spark, x)
    same(scans.cumulative(v, "sum"), np.cumsum(x))
    same(scans.cumulative(v, "min"), np.minimum.accumulate(x))
    same(scans.diff(v), np.diff(x))
    same(scans.gradient(v, 1.0, 0, 2), np.gradient(x, edge_order=2))


def test_sets(spark):
    a, b = vec(spark, [3, 1, 2, 1]), vec(spark, [2, 5, 3])
    assert ordering.intersect1d(a, b).to_list() == [2, 3] and ordering.union1d(a, b).to_list() == [1, 2, 3, 5]
    assert ordering.setdiff1d(a, b).to_list() == [1] and ordering.setxor1d(a, b).to_list() == [1, 5] and ordering.isin(a, b).to_list() == [True, False, True, False]
    assert ordering.find_index(a, "lt", 3) == (1,) and ordering.find_index(a, "gt", 9) is None
    assert ordering.put_along_axis(a, vec(spark, [0, 0]), vec(spark, [7, 8]), 0).to_list() == [8, 1, 2, 1]


def test_masked(spark):
    m = masked.MaskedArray(vec(spark, [[1.0, 2], [3, 4]]), vec(spark, [[False, True], [False, False]]))
    assert m.size == 4 and m.fill_value == 1e20 and m.sum().data.item() == 8 and m.count(0).data.to_list() == [2, 1]
    assert m.compressed().to_list() == [1, 3, 4] and m.filled(0).to_list() == [[1, 0], [3, 4]]
    assert (m / 0.0).count().data.item() == 0 and m.mask.to_list() == [[False, True], [False, False]]


def test_random(spark):
    u = random.uniform(spark, (50, 20), seed=4).numpy()
    assert (u == random.uniform(spark, (50, 20), seed=4).numpy()).all() and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    assert abs(random.normal(spark, (2000,), seed=1).numpy().mean()) < 0.1
    a = shaping.arange(spark, 0, 10)
    assert sorted(random.permutation(a, 3).to_list()) == list(range(10)) and len(set(random.choice(a, 5, False, seed=2).to_list())) == 5
    assert set(random.choice(a, 50, True, SparkArray.of(spark, [0.0] * 9 + [1.0]), 1).to_list()) == {9.0}
    assert abs(random.poisson(spark, (3000,), 4.0, 2).numpy().mean() - 4) < 0.3


def test_polynomials_and_optimizers(spark):
    x = spark.createDataFrame([(v / 7,) for v in range(-20, 20)], "x double")
    c = [1.0, -2.0, 0.5, 3.0]
    got = x.select("x", polynomials.polyval(c, "x").alias("p"), polynomials.chebval(c, "x").alias("t"), polynomials.legval(c, "x").alias("l"), polynomials.hermval(c, "x").alias("h"), polynomials.lagval(c, "x").alias("g")).toPandas()
    p = np.polynomial
    for n, f in (("p", lambda v: np.polyval(c, v)), ("t", lambda v: p.chebyshev.chebval(v, c)), ("l", lambda v: p.legendre.legval(v, c)), ("h", lambda v: p.hermite.hermval(v, c)), ("g", lambda v: p.laguerre.lagval(v, c))):
        assert np.allclose(got[n], f(got.x))
    fit = polynomials.polyfit(x.withColumn("y", polynomials.polyval(c, "x")), "x", "y", 3)
    assert np.allclose(fit, c)
    assert abs(optimize.brentq(lambda v: v * v - 4, 0, 3) - 2) < 1e-9 and abs(optimize.newton(lambda v: v * v - 4, 3) - 2) < 1e-6
    best, value, _ = optimize.lbfgs(lambda v: ((v[0] - 1) ** 2 + 10 * (v[1] + 2) ** 2, np.array([2 * (v[0] - 1), 20 * (v[1] + 2)])), [5, 5])
    assert np.allclose(best, [1, -2], atol=1e-4) and value < 1e-8
    assert np.allclose(optimize.minimize(lambda v: (v[0] - 3) ** 2 + v[1] ** 2, [0, 1])[0], [3, 0], atol=1e-3)
    with pytest.raises(ValueError):
        optimize.brentq(lambda v: v * v + 1, 0, 3)


def test_creation(spark):
    same(shaping.linspace(spark, 2, 3, 5, False), np.linspace(2, 3, 5, False))
    same(shaping.mgrid(spark, [(0, 3, 1), (0, 2, 1)]), np.mgrid[0:3, 0:2])
    same(shaping.ogrid(spark, [(0, 3, 1), (0, 2, 1)])[1], np.ogrid[0:3, 0:2][1])
    same(shaping.spaced_grid(vec(spark, [0.0, 1]), vec(spark, [1.0, 3]), 3), np.linspace([0, 1], [1, 3], 3))
    same(shaping.full(spark, (2, 0), 1.0), np.ones((2, 0)))
    assert shaping.scalar(spark, 3.0).item() == 3
