"""Queries through ``SparkArray`` over the whole matrix of embeddings (vec_id x component), with their SQL.

Every entry is a name, what is built from the matrix ``m``, and the SQL over its
cells ``m(i0, i1, v)``. Values are rounded; no result has a negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import masked
from .operators import contractions as con
from .operators import kernels as ker
from .operators import ordering as order
from .operators import reductions as red
from .operators import scans, shaping
from .plans import nn
from .plans.array import SparkArray

Entry = tuple[str, Callable[[SparkArray], SparkArray], str]
ROWS = "(SELECT max(i0) + 1 FROM m)"
KEY = "SELECT DISTINCT i0 FROM m"


def rounded(a: SparkArray, digits: int = 5) -> DataFrame:
    return a.map(lambda v: F.round(v.cast("double"), digits) + 0.0).df


def _mask(m: SparkArray) -> masked.MaskedArray:
    return masked.MaskedArray(m, m > 1.0)


def _whole(m: SparkArray) -> SparkArray:
    return m.map(lambda v: F.floor(v * 100).cast("bigint"), "int64")


def _ids(m: SparkArray) -> SparkArray:
    """A component for each row: its number modulo 64."""
    return SparkArray(m.df.where("i1 = 0").select("i0", (F.col("i0") % 64).alias("v")), (m.shape[0],), "int64")


def _means(m: SparkArray) -> SparkArray:
    return red.reduce(m, "mean", 0)


# axes and shapes
SHAPES: list[Entry] = [
    ("expand_dims", lambda m: m.expand_dims(1), "SELECT i0, 0::BIGINT AS i1, i1 AS i2, v FROM m"),
    ("squeeze", lambda m: m.expand_dims(0).expand_dims(3).squeeze(), "SELECT i0, i1, v FROM m"),
    ("swapaxes", lambda m: m.swapaxes(0, 1), "SELECT i1 AS i0, i0 AS i1, v FROM m"),
    ("moveaxis", lambda m: m.reshape(-1, 8, 8).moveaxis(0, 2), "SELECT i1 // 8 AS i0, i1 % 8 AS i1, i0 AS i2, v FROM m"),
    ("copy", lambda m: m.copy(), "SELECT i0, i1, v FROM m"),
    ("fill", lambda m: m.copy().fill(2.5), "SELECT i0, i1, 2.5 AS v FROM m"),
    ("ones_like", lambda m: shaping.ones(m.spark, m.shape), "SELECT i0, i1, 1.0 AS v FROM m"),
    ("full", lambda m: shaping.full(m.spark, m.shape, 7.0), "SELECT i0, i1, 7.0 AS v FROM m"),
    ("vstack", lambda m: shaping.vstack([m, m]), f"SELECT i0, i1, v FROM m UNION ALL SELECT i0 + {ROWS}, i1, v FROM m"),
    ("hstack", lambda m: shaping.hstack([m, m]), "SELECT i0, i1, v FROM m UNION ALL SELECT i0, i1 + 64, v FROM m"),
    ("dstack", lambda m: shaping.dstack([m, m.flip(1)]), "SELECT i0, i1, 0::BIGINT AS i2, v FROM m UNION ALL SELECT i0, 63 - i1, 1, v FROM m"),
    ("column_stack", lambda m: shaping.column_stack([m, m]), "SELECT i0, i1, v FROM m UNION ALL SELECT i0, i1 + 64, v FROM m"),
    ("diag", lambda m: shaping.diag(_means(m)), "SELECT a.i1 AS i0, b.i1 AS i1, CASE WHEN a.i1 = b.i1 THEN a.v ELSE 0 END AS v FROM (SELECT i1, avg(v) AS v FROM m GROUP BY i1) a, (SELECT DISTINCT i1 FROM m) b"),
    ("array_split", lambda m: shaping.array_split(m, 3, 1)[1], "SELECT i0, i1 - 22 AS i1, v FROM m WHERE i1 BETWEEN 22 AND 42"),
    ("array_split_at", lambda m: shaping.array_split_at(m, [10, 40], 1)[2], "SELECT i0, i1 - 40 AS i1, v FROM m WHERE i1 >= 40"),
    ("hsplit", lambda m: shaping.hsplit(m, 4)[3], "SELECT i0, i1 - 48 AS i1, v FROM m WHERE i1 >= 48"),
    ("hsplit_at", lambda m: shaping.hsplit_at(m, [5])[1], "SELECT i0, i1 - 5 AS i1, v FROM m WHERE i1 >= 5"),
    ("vsplit", lambda m: shaping.vsplit(m.transpose(), 2)[1], "SELECT i1 - 32 AS i0, i0 AS i1, v FROM m WHERE i1 >= 32"),
    ("vsplit_at", lambda m: shaping.vsplit_at(m.transpose(), [7])[1], "SELECT i1 - 7 AS i0, i0 AS i1, v FROM m WHERE i1 >= 7"),
    ("dsplit", lambda m: shaping.dsplit(m.reshape(-1, 8, 8), 2)[1], "SELECT i0, i1 // 8 AS i1, i1 % 8 - 4 AS i2, v FROM m WHERE i1 % 8 >= 4"),
    ("dsplit_at", lambda m: shaping.dsplit_at(m.reshape(-1, 8, 8), [3])[1], "SELECT i0, i1 // 8 AS i1, i1 % 8 - 3 AS i2, v FROM m WHERE i1 % 8 >= 3"),
    ("as_strided", lambda m: shaping.as_strided(m, (m.shape[0], 62, 3), (64, 1, 1)), "SELECT i0, i1 - k AS i1, k AS i2, v FROM m, range(3) x(k) WHERE i1 - k BETWEEN 0 AND 61"),
    ("spaced_grid", lambda m: shaping.spaced_grid(_means(m), _means(m).map(lambda v: v + 8), 5), "SELECT k AS i0, i1, avg(v) + 2 * k AS v FROM m, range(5) x(k) GROUP BY i1, k"),
    ("take_array", lambda m: m.take_array(_ids(m)), f"SELECT a.i0, b.i1, b.v FROM ({KEY}) a JOIN m b ON b.i0 = a.i0 % 64"),
]

#: The cell that each padded place takes, of 64 with two before and one after.
SOURCE = {"edge": "least(greatest(p - 2, 0), 63)", "reflect": "CASE WHEN p < 2 THEN 2 - p WHEN p > 65 THEN 62 ELSE p - 2 END", "symmetric": "CASE WHEN p < 2 THEN 1 - p WHEN p > 65 THEN 63 ELSE p - 2 END", "wrap": "(p + 62) % 64"}
SHAPES += [(f"pad_{mode}", lambda m, mode=mode: shaping.pad(m, [(0, 0), (2, 1)], mode), f"SELECT i0, p AS i1, v FROM m JOIN (SELECT p, {at} AS s FROM range(67) x(p)) ON i1 = s") for mode, at in SOURCE.items()]
SHAPES += [
    (f"pad_{mode}", lambda m, mode=mode: shaping.pad(m, [(0, 0), (2, 1)], mode), f"SELECT i0, i1 + 2 AS i1, v FROM m UNION ALL SELECT i0, unnest([0, 1, 66]), {how} FROM m GROUP BY i0")
    for mode, how in (("constant", "0.0"), ("mean", "avg(v)"), ("median", "median(v)"), ("min", "min(v)"), ("max", "max(v)"))
]
SHAPES.append(("pad_linearRamp", lambda m: shaping.pad(m, [(0, 0), (2, 1)], "linearRamp", end=1.0), """SELECT i0, i1 + 2 AS i1, v FROM m
 UNION ALL SELECT i0, k, v + (1.0 - v) * (2 - k) / 2 FROM m, (VALUES (0), (1)) x(k) WHERE i1 = 0 UNION ALL SELECT i0, 66, 1.0 FROM m WHERE i1 = 63"""))  # fmt: skip

_RANK = "SELECT i0, i1 AS j, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, v FROM m"
ORDERED: list[Entry] = [
    ("partition", lambda m: order.partition(m, 5, 1), f"SELECT i0, i1, v FROM ({_RANK})"),
    ("argpartition", lambda m: order.argpartition(m, 5, 1), f"SELECT i0, i1, j AS v FROM ({_RANK})"),
    ("argsort_rows", lambda m: order.argsort(m, 1), f"SELECT i0, i1, j AS v FROM ({_RANK})"),
    ("where", lambda m: order.where(m > 0.5, m, -1.0), "SELECT i0, i1, CASE WHEN v > 0.5 THEN v ELSE -1 END AS v FROM m"),
    ("nonzero", lambda m: order.nonzero((m > 2.0).astype("int64"))[1], "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, i1 AS v FROM m WHERE v > 2"),
    ("flatnonzero", lambda m: order.flatnonzero((m > 2.0).astype("int64")), "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, i0 * 64 + i1 AS v FROM m WHERE v > 2"),
    ("extract", lambda m: order.extract(m > 2.0, m), "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, v FROM m WHERE v > 2"),
    ("put_along_axis", lambda m: order.put_along_axis(m, red.arg_reduce(m, "argmax", 1).expand_dims(1), 0.0, 1), "SELECT i0, i1, CASE WHEN row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) = 1 THEN 0 ELSE v END AS v FROM m"),
    ("argmin_rows", lambda m: red.arg_reduce(m, "argmin", 1), "SELECT i0, arg_min(i1, (v, i1)) AS v FROM m GROUP BY i0"),
]

_NEIGHBOURS = "SELECT i0, i1, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM m WINDOW w AS (PARTITION BY i0 ORDER BY i1)"
_AXIS_GRADIENT = f"SELECT i0, i1, CASE WHEN a IS NULL THEN (b - v) / 2 WHEN b IS NULL THEN (v - a) / 2 ELSE (b - a) / 4 END AS v FROM ({_NEIGHBOURS})"
PRODUCTS: list[Entry] = [
    ("convolve2d", lambda m: con.convolve2d(m, SparkArray.of(m.spark, [[1.0, 2.0], [3.0, 4.0]]), "valid"), """SELECT a.i0, a.i1, d.v + 2 * c.v + 3 * b.v + 4 * a.v AS v FROM m a
 JOIN m b ON b.i0 = a.i0 AND b.i1 = a.i1 + 1 JOIN m c ON c.i0 = a.i0 + 1 AND c.i1 = a.i1 JOIN m d ON d.i0 = a.i0 + 1 AND d.i1 = a.i1 + 1"""),
    ("correlate2d", lambda m: con.correlate(m, SparkArray.of(m.spark, [[1.0, 2.0], [3.0, 4.0]]), "valid"), """SELECT a.i0, a.i1, a.v + 2 * b.v + 3 * c.v + 4 * d.v AS v FROM m a
 JOIN m b ON b.i0 = a.i0 AND b.i1 = a.i1 + 1 JOIN m c ON c.i0 = a.i0 + 1 AND c.i1 = a.i1 JOIN m d ON d.i0 = a.i0 + 1 AND d.i1 = a.i1 + 1"""),
    ("vdot", lambda m: con.vdot(m, m.flip(1)), "SELECT sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1"),
    ("gradients", lambda m: scans.gradients(m, 2.0, [1])[0], _AXIS_GRADIENT),
    ("diff_rows", lambda m: scans.diff(m, 2, 1), "SELECT i0, i1, c - 2 * b + v AS v FROM (SELECT i0, i1, v, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM m WINDOW w AS (PARTITION BY i0 ORDER BY i1)) WHERE c IS NOT NULL"),
    ("trapz_rows", lambda m: scans.trapz(m, 0.5, 1), f"SELECT i0, sum((v + b) / 4) AS v FROM ({_NEIGHBOURS}) WHERE b IS NOT NULL GROUP BY i0"),
    ("accumulate_or", lambda m: ker.accumulate(_whole(m), "bitwiseOr", 1), "SELECT i0, i1, bit_or(CAST(floor(v * 100) AS BIGINT)) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM m"),
    ("accumulate_and", lambda m: ker.accumulate(_whole(m), "bitwiseAnd", 1), "SELECT i0, i1, bit_and(CAST(floor(v * 100) AS BIGINT)) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM m"),
    ("accumulate_xor", lambda m: ker.accumulate(_whole(m), "bitwiseXor", 1), "SELECT i0, i1, bit_xor(CAST(floor(v * 100) AS BIGINT)) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM m"),
    ("accumulate_logaddexp", lambda m: ker.accumulate(m, "logaddexp", 1), "SELECT i0, i1, ln(sum(exp(v)) OVER (PARTITION BY i0 ORDER BY i1)) AS v FROM m"),
    ("cumprod_rows", lambda m: scans.cumulative(m.map(lambda v: 1 + v / 100), "prod", 1), "SELECT i0, i1, product(1 + v / 100) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM m"),
    ("ifftshift", lambda m: ker.ifftshift(m[:, :63], 1), "SELECT i0, (i1 + 32) % 63 AS i1, v FROM m WHERE i1 < 63"),
]

_CENTRED = "SELECT i0, i1, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS v FROM m WINDOW w AS (PARTITION BY i0)"
_LOG_SOFTMAX = "SELECT i0, i1, v - ln(sum(exp(v)) OVER (PARTITION BY i0)) AS v FROM m"
LAYERS: list[Entry] = [
    ("log_softmax", lambda m: nn.log_softmax(m), _LOG_SOFTMAX),
    ("mse_loss", lambda m: nn.mse_loss(m, m.flip(1)), "SELECT avg((a.v - b.v) * (a.v - b.v)) AS v FROM m a JOIN m b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1"),
    ("cross_entropy", lambda m: nn.cross_entropy(m, _ids(m)), f"SELECT -avg(v) AS v FROM ({_LOG_SOFTMAX}) WHERE i1 = i0 % 64"),
    ("linear", lambda m: nn.linear(m, shaping.full(m.spark, (2, 64), 0.5), shaping.ones(m.spark, (2,))), "SELECT i0, k AS i1, 0.5 * sum(v) + 1 AS v FROM m, range(2) x(k) GROUP BY i0, k"),
    ("layer_norm", lambda m: nn.layer_norm(m, shaping.full(m.spark, (64,), 2.0), shaping.ones(m.spark, (64,))), f"SELECT i0, i1, 2 * v + 1 AS v FROM ({_CENTRED})"),
    ("rms_norm", lambda m: nn.rms_norm(m, shaping.ones(m.spark, (64,))), "SELECT i0, i1, v / sqrt(avg(v * v) OVER (PARTITION BY i0) + 1e-6) AS v FROM m"),
    ("embedding", lambda m: nn.embedding(m, _ids(m)), f"SELECT a.i0, b.i1, b.v FROM ({KEY}) a JOIN m b ON b.i0 = a.i0 % 64"),
    ("dropout_off", lambda m: nn.dropout(m, 0.5, training=False), "SELECT i0, i1, v FROM m"),
    ("attention", lambda m: nn.attention(_means(m).reshape(8, 8), _means(m).reshape(8, 8), _means(m).reshape(8, 8)), """WITH q AS (SELECT i1 // 8 AS i, i1 % 8 AS j, avg(v) AS v FROM m GROUP BY i1),
 s AS (SELECT a.i, b.i AS k, sum(a.v * b.v) / sqrt(8.0) AS s FROM q a JOIN q b USING (j) GROUP BY 1, 2), p AS (SELECT i, k, exp(s) / sum(exp(s)) OVER (PARTITION BY i) AS p FROM s)
 SELECT p.i AS i0, q.j AS i1, sum(p * v) AS v FROM p JOIN q ON q.i = k GROUP BY 1, 2"""),
]

MASKED: list[Entry] = [
    (f"masked_{name}_columns", lambda m, name=name: getattr(_mask(m), name)(0).data, f"SELECT i1 AS i0, {how} AS v FROM m WHERE v <= 1 GROUP BY i1")
    for name, how in (("sum", "sum(v)"), ("min", "min(v)"), ("max", "max(v)"), ("variance", "var_pop(v)"), ("std", "stddev_pop(v)"), ("count", "count(*)"))
]
MASKED += [
    ("masked_filled", lambda m: _mask(m).filled(0.0), "SELECT i0, i1, CASE WHEN v > 1 THEN 0 ELSE v END AS v FROM m"),
    ("masked_mask", lambda m: _mask(m).mask.astype("int64"), "SELECT i0, i1, (v > 1)::INT AS v FROM m"),
    ("masked_map", lambda m: _mask(m).map_unary(lambda v: v * v).filled(-1.0), "SELECT i0, i1, CASE WHEN v > 1 THEN -1 ELSE v * v END AS v FROM m"),
    ("masked_add", lambda m: (_mask(m) + _mask(m.flip(1))).filled(9.0), "SELECT a.i0, a.i1, CASE WHEN a.v > 1 OR b.v > 1 THEN 9 ELSE a.v + b.v END AS v FROM m a JOIN m b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1"),
    ("masked_put", lambda m: _mask(m).put([slice(None), 0], None).filled(5.0), "SELECT i0, i1, CASE WHEN v > 1 OR i1 = 0 THEN 5 ELSE v END AS v FROM m"),
    ("masked_expand", lambda m: _mask(m).expand_dims(0).filled(0.0), "SELECT 0::BIGINT AS i0, i0 AS i1, i1 AS i2, CASE WHEN v > 1 THEN 0 ELSE v END AS v FROM m"),
]

#: Reductions along the components, with the axis kept, and of all cells.
HOW = {
    "sum": "sum(v)", "mean": "avg(v)", "variance": "var_pop(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "ptp": "max(v) - min(v)", "all": "min((v <> 0)::INT)", "any": "max((v <> 0)::INT)",
    "count_nonzero": "count(*) FILTER (v <> 0)", "median": "median(v)", "nansum": "sum(v)", "nanmean": "avg(v)", "nanvar": "var_pop(v)", "nanstd": "stddev_pop(v)", "nanmin": "min(v)", "nanmax": "max(v)", "logaddexp": "ln(sum(exp(v)))",
}
REDUCED: list[Entry] = [(f"nd_{name}_kept", lambda m, name=name: red.reduce(m, name, 1, True), f"SELECT i0, 0::BIGINT AS i1, {how} AS v FROM m GROUP BY i0") for name, how in HOW.items()]
REDUCED += [(f"nd_{name}_cells", lambda m, name=name: red.reduce(m, name), f"SELECT {how} AS v FROM m") for name, how in HOW.items() if name != "logaddexp"]
REDUCED += [
    ("nd_quantile", lambda m: red.quantile_array(m, 0.3, 0), "SELECT i1 AS i0, quantile_cont(v, 0.3) AS v FROM m GROUP BY i1"),
    ("nd_percentile", lambda m: red.percentile_array(m, 90.0), "SELECT quantile_cont(v, 0.9) AS v FROM m"),
    ("nd_norm_1", lambda m: red.norm(m, 1, 1), "SELECT i0, sum(abs(v)) AS v FROM m GROUP BY i0"),
    ("nd_norm_3", lambda m: red.norm(m, 3, 1), "SELECT i0, pow(sum(pow(abs(v), 3)), 1 / 3.0) AS v FROM m GROUP BY i0"),
    ("nd_norm_matrix", lambda m: red.norm(m, 1, (0, 1)), "SELECT max(s) AS v FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i1)"),
]

ENTRIES = [*SHAPES, *ORDERED, *PRODUCTS, *LAYERS, *MASKED, *REDUCED]


def register(queries: dict, oracles: dict, matrix: Callable, cells: str) -> None:
    """Add the entries, of ``matrix(spark, sf_dir)`` and of the SQL of its cells."""
    for name, build, sql in ENTRIES:
        if name in queries:
            raise ValueError(f"two queries are named {name}")
        queries[name] = lambda spark, sf_dir, f=build: rounded(f(matrix(spark, sf_dir)))
        oracles[name] = f"WITH m AS ({cells}) SELECT * REPLACE (round(CAST(v AS DOUBLE), 5) + 0.0 AS v) FROM ({sql})"
