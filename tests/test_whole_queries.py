"""Queries over every row of embeddings: against DuckDB's SQL and numpy."""

import duckdb
import numpy as np
import pytest

from tesserine import queries
from tesserine.operators import kernels as ker
from tesserine.operators import reductions as red
from tesserine.plans.array import SparkArray

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    return np.stack([np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()])


def against_sql(spark, name, atol=2e-5):
    """The query's rows are those of its SQL, whatever their order; columns meet by name."""
    got = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("embeddings", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = got.columns
    want = db.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) == len(want)
    assert np.allclose(np.array(rows, float), np.array(sorted(want), float), rtol=1e-9, atol=atol), name


WHOLE = ["concatenate", "stack", "tile", "repeat", "pad", "put", "rot90", "outer", "kron", "inner", "multi_dot", "cdist", "pdist"]
TRANSFORMS = ["complex_matmul", "complex_sum", "complex_mean", "complex_einsum", "fft", "ifft", "rfft", "irfft", "fft2", "fftshift"]
FACTORS = ["qr", "svd", "eigh", "cholesky", "lu", "hessenberg", "eig", "schur", "inv", "solve", "pinv", "lstsq", "det", "slogdet", "matrix_power", "roots", "irr"]


OTHERS = ["npy", "npz", "safetensors", "brentq", "newton", "root_scalar", "nelder_mead", "lbfgs", "minimize", "convolve", "unwrap", "reduce_gcd_axis", "reduce_gcd_all", "cov", "corrcoef", "matmul", "quantile_hazen", "quantile_nearest"]


@pytest.mark.parametrize("name", WHOLE + TRANSFORMS + FACTORS + [n for n in OTHERS if not n.endswith(("_axis", "hazen", "nearest"))])
def test_against_sql(spark, name):
    against_sql(spark, name, 2e-4 if name in ("multi_dot", "lstsq") else 2e-5)


def test_no_query_takes_the_first_rows_of_a_matrix(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for name, rows in {"concatenate": 128 * n, "stack": 128 * n, "tile": 128 * n, "repeat": 128 * n, "pad": 64 * (n + 1), "put": 64 * n, "rot90": 64 * n, "pdist": n * (n - 1) // 2, "multi_dot": 64 * n}.items():
        assert queries.QUERIES[name](spark, SF).count() == rows


def test_kernels_against_numpy(spark, matrix):
    m = queries._matrix(spark, SF)

    def dense(a):
        out = np.zeros(a.shape, complex)
        for r in a.df.collect():
            out[tuple(r)[:-1]] = complex(r[-1].re, r[-1].im) if hasattr(r[-1], "re") else r[-1]
        return out

    g, gram = matrix.T @ matrix, queries._gram(m)
    for got, want in (
        (ker.fft2(m), np.fft.fft2(matrix)), (ker.inv(gram), np.linalg.inv(g)), (ker.solve(gram, m.transpose()), np.linalg.inv(g) @ matrix.T), (ker.qr(m)[1], np.linalg.qr(matrix)[1]), (ker.svd(m)[1], np.linalg.svd(matrix)[1]),
        (ker.pinv(m), np.linalg.pinv(matrix)), (ker.lstsq(m[:, :63], m[:, 63])[0], np.linalg.lstsq(matrix[:, :63], matrix[:, 63], rcond=None)[0]),
    ):
        assert np.allclose(dense(got), want, rtol=1e-6, atol=1e-9 * np.abs(want).max())


def test_accumulate_keeps_integers(spark):
    big = (1 << 53) + 1
    a = SparkArray(spark.createDataFrame([(0, big), (1, -1), (2, big)], "i0 bigint, v bigint"), (3,), "int64")
    got = ker.accumulate(a, "bitwiseAnd")
    assert got.dtype == "int64" and [r.v for r in got.df.orderBy("i0").collect()] == [big] * 3


@pytest.mark.parametrize("method", list(red.QUANTILES))
def test_quantiles_of_odd_values(spark, method):
    x = [0.0, -0.0, 1.0, 1.0 + 2**-52, 2.0 - 2**-52, 2.0, -2.0, -2.0 + 2**-51, 1e300, -1e300, 5e-324, -5e-324, 4.0, 4.0, 4.0, 3.9999999999999996, 1024.0, 1023.9999999999999]
    rows = [("a", v) for v in x] + [("b", 7.0)] + [(None, v) for v in x[:5]]
    df = spark.createDataFrame(rows, "g string, v double")
    numpy_names = {"invertedCdf": "inverted_cdf", "averagedInvertedCdf": "averaged_inverted_cdf", "closestObservation": "closest_observation", "interpolatedInvertedCdf": "interpolated_inverted_cdf", "medianUnbiased": "median_unbiased", "normalUnbiased": "normal_unbiased"}
    for q in (0.0, 0.31, 0.5, 0.77, 1.0):
        got = {r.g: r.v for r in red.quantile(df, "v", q, method, ("g",)).collect()}
        for g in ("a", "b", None):
            want = np.quantile([v for k, v in rows if k == g], q, method=numpy_names.get(method, method))
            assert np.isclose(got[g], want, rtol=1e-12, atol=0) or abs(got[g] - want) < 1e-290, (g, q)
    none = red.quantile(df.union(spark.createDataFrame([("b", float("nan"))], "g string, v double")), "v", 0.5, method, ("g",)).where("g = 'b'").head()
    assert np.isnan(none.v) and np.isinf(red.quantile(spark.createDataFrame([(float("inf"),)], "v double"), "v", 0.5, method).head().v)
