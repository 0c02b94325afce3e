"""Queries over the tables, one for each operator, with the SQL that says the same."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matrix_queries
from .functions import masked, symbolic
from .functions import ufuncs as u
from .operators import contractions as con
from .operators import kernels as ker
from .operators import optimize
from .operators import ordering as order
from .operators import polynomials as poly
from .operators import random as rnd
from .operators import reductions as red
from .operators import scans, shaping
from .plans import storage
from .plans.array import SparkArray
from .sources import files
from .streaming import tuner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# element-wise: numbers of either sign, zeros and bounded ones, with the order's key
CELLS_SQL = """WITH t AS (SELECT o_orderkey AS k, o_totalprice / 1000.0 - 150.0 AS a, CAST(o_orderkey % 7 - 3 AS DOUBLE) AS b,
 (o_orderkey % 201 - 100) / 100.0 AS c, o_totalprice / 100000.0 AS p, CAST(o_custkey AS BIGINT) AS i, CAST(o_orderkey % 17 + 1 AS BIGINT) AS j FROM orders)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("k"), (F.col("o_totalprice") / 1000.0 - 150.0).alias("a"), (key % 7 - 3).cast("double").alias("b"), ((key % 201 - 100) / 100.0).alias("c"),
        (F.col("o_totalprice") / 100000.0).alias("p"), F.col("o_custkey").cast("bigint").alias("i"), (key % 17 + 1).cast("bigint").alias("j"),
    )


def _ufunc(name: str, f, sql: str, digits: int | None = 6) -> None:
    def run(spark, sf_dir):
        v = f()
        return cells(spark, sf_dir).select("k", (F.round(v, digits) if digits is not None else v).alias("v"))

    QUERIES[name] = run
    ORACLES[name] = CELLS_SQL + f"SELECT k, {f'round({sql}, {digits})' if digits is not None else sql} AS v FROM t"


NANSAFE = "CASE WHEN {0} THEN CAST('nan' AS DOUBLE) ELSE {1} END"
for _name, _f, _sql in (
    ("add", lambda: u.add("a", "b"), "a + b"), ("subtract", lambda: u.subtract("a", "b"), "a - b"), ("multiply", lambda: u.multiply("a", "c"), "a * c"),
    ("divide", lambda: u.divide("a", "b"), "CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN CAST('inf' AS DOUBLE) WHEN a < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END ELSE a / b END"),
    ("negative", lambda: u.negative("a"), "-a"), ("positive", lambda: u.positive("a"), "a"), ("square", lambda: u.square("a"), "a * a"),
    ("sqrt", lambda: u.sqrt("a"), NANSAFE.format("a < 0", "sqrt(abs(a))")), ("cbrt", lambda: u.cbrt("a"), "cbrt(a)"),
    ("reciprocal", lambda: u.reciprocal("b"), "CASE WHEN b = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / b END"),
    ("absolute", lambda: u.abs("a"), "abs(a)"), ("sign", lambda: u.sign("a"), "CAST(sign(a) AS DOUBLE)"), ("ceil", lambda: u.ceil("a"), "ceil(a)"), ("floor", lambda: u.floor("a"), "floor(a)"),
    ("rint", lambda: u.rint(F.col("b") / 2), "round_even(b / 2, 0)"), ("round", lambda: u.round("a"), "round(a)"), ("trunc", lambda: u.trunc("a"), "trunc(a)"), ("fix", lambda: u.fix("a"), "trunc(a)"),
    ("power", lambda: u.power("p", "b"), "pow(p, b)"), ("float_power", lambda: u.float_power("p", "c"), "pow(p, c)"), ("expm1", lambda: u.expm1("c"), "exp(c) - 1"), ("log1p", lambda: u.log1p("p"), "ln(1 + p)"),
    ("logaddexp", lambda: u.logaddexp("b", "c"), "ln(exp(b) + exp(c))"), ("logaddexp2", lambda: u.logaddexp2("b", "c"), "log2(pow(2, b) + pow(2, c))"),
    ("heaviside", lambda: u.heaviside("b", F.lit(0.5)), "CASE WHEN b < 0 THEN 0.0 WHEN b = 0 THEN 0.5 ELSE 1.0 END::DOUBLE"),
    ("maximum", lambda: u.maximum("a", "b"), "greatest(a, b)"), ("minimum", lambda: u.minimum("a", "b"), "least(a, b)"), ("fmax", lambda: u.fmax("a", "b"), "greatest(a, b)"), ("fmin", lambda: u.fmin("a", "b"), "least(a, b)"),
    ("floor_divide", lambda: u.floor_divide("a", "b"), NANSAFE.format("b = 0", "floor(a / b)")), ("remainder", lambda: u.remainder("a", "b"), NANSAFE.format("b = 0", "a - floor(a / b) * b")),
    ("mod", lambda: u.mod("a", "p"), "a - floor(a / p) * p"), ("fmod", lambda: u.fmod("a", "b"), NANSAFE.format("b = 0", "a - trunc(a / b) * b")),
    ("exp", lambda: u.exp("c"), "exp(c)"), ("log", lambda: u.log("b"), "CASE WHEN b < 0 THEN CAST('nan' AS DOUBLE) WHEN b = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(abs(b)) END"),
    ("log2", lambda: u.log2("p"), "log2(p)"), ("log10", lambda: u.log10("p"), "log10(p)"),
    ("sin", lambda: u.sin("a"), "sin(a)"), ("cos", lambda: u.cos("a"), "cos(a)"), ("tan", lambda: u.tan("c"), "tan(c)"), ("asin", lambda: u.asin("c"), "asin(c)"), ("acos", lambda: u.acos("c"), "acos(c)"), ("atan", lambda: u.atan("a"), "atan(a)"),
    ("sinh", lambda: u.sinh("c"), "sinh(c)"), ("cosh", lambda: u.cosh("c"), "cosh(c)"), ("tanh", lambda: u.tanh("b"), "tanh(b)"), ("asinh", lambda: u.asinh("b"), "asinh(b)"), ("acosh", lambda: u.acosh(F.col("p") + 1), "acosh(p + 1)"),
    ("atanh", lambda: u.atanh(F.col("c") / 2), "atanh(c / 2)"), ("sinc", lambda: u.sinc("c"), "CASE WHEN c = 0 THEN 1.0 ELSE sin(pi() * c) / (pi() * c) END"),
    ("atan2", lambda: u.atan2("a", "b"), "atan2(a, b)"), ("hypot", lambda: u.hypot("a", "b"), "sqrt(a * a + b * b)"), ("deg2rad", lambda: u.deg2rad("a"), "radians(a)"), ("rad2deg", lambda: u.rad2deg("c"), "degrees(c)"),
    ("copysign", lambda: u.copysign("a", "b"), "CASE WHEN b < 0 THEN -abs(a) ELSE abs(a) END"),
    ("nan_to_num", lambda: u.nan_to_num(u.log("b"), 7.0, neginf=-9.0), "CASE WHEN b < 0 THEN 7.0 WHEN b = 0 THEN -9.0 ELSE ln(abs(b)) END"),
    ("clip", lambda: u.clip("a", -50.0, 50.0), "least(greatest(a, -50.0), 50.0)"), ("clip_array", lambda: u.clip_array("a", "b", F.col("b") + 10), "least(greatest(a, b), b + 10)"),
    ("where_mask", lambda: u.sqrt("p", where=F.col("b") > 0, out=F.lit(100.0)), "CASE WHEN b > 0 THEN sqrt(p) ELSE 100.0 END"),
    ("gamma", lambda: u.gamma(F.col("p") + 0.5), "gamma(p + 0.5)"),
    ("choose", lambda: u.choose(F.col("k") % 3, ["a", "b", "c"]), "CASE k % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END"), ("select", lambda: u.select([F.col("b") > 1, F.col("b") > 0], ["a", "c"], -1.0), "CASE WHEN b > 1 THEN a WHEN b > 0 THEN c ELSE -1.0 END"),
    ("fv", lambda: u.fv(F.col("c") / 10, F.lit(10.0), F.lit(-100.0), "a"), "CASE WHEN c = 0 THEN -(a + -100.0 * 10) ELSE -(a * pow(1 + c / 10, 10) + -100.0 / (c / 10) * (pow(1 + c / 10, 10) - 1)) END"),
    ("pv", lambda: u.pv(F.col("c") / 10, F.lit(10.0), F.lit(-100.0), "a"), "CASE WHEN c = 0 THEN -(a + -100.0 * 10) ELSE -(a + -100.0 / (c / 10) * (pow(1 + c / 10, 10) - 1)) / pow(1 + c / 10, 10) END"),
    ("relu", lambda: u.relu("b"), "greatest(b, 0.0)"), ("sigmoid", lambda: u.sigmoid("b"), "1 / (1 + exp(-b))"), ("silu", lambda: u.silu("b"), "b / (1 + exp(-b))"), ("softplus", lambda: u.softplus("b"), "ln(1 + exp(b))"),
    ("gelu", lambda: u.gelu("c"), "0.5 * c * (1 + tanh(sqrt(2 / pi()) * (c + 0.044715 * c * c * c)))"), ("mish", lambda: u.mish("c"), "c * tanh(ln(1 + exp(c)))"), ("hardswish", lambda: u.hardswish("b"), "b * least(greatest(b + 3, 0), 6) / 6"), ("rsqrt", lambda: u.rsqrt("p"), "1 / sqrt(p)"),
    ("complex_abs", lambda: u.complex_abs(u.complex("a", "b")), "sqrt(a * a + b * b)"), ("complex_angle", lambda: u.angle(u.complex("b", "c")), "atan2(c, b)"), ("complex_real", lambda: u.real(u.complex_multiply(u.complex("a", "b"), u.complex("c", "p"))), "a * c - b * p"),
    ("complex_imag", lambda: u.imag(u.conj(u.complex("a", "b"))), "-b"), ("complex_divide", lambda: u.real(u.complex_divide(u.complex("a", "b"), u.complex("p", "c"))), "(a * p + b * c) / (p * p + c * c)"), ("complex_exp", lambda: u.imag(u.complex_exp(u.complex("c", "b"))), "exp(c) * sin(b)"),
    ("polyval", lambda: poly.polyval([2.0, -1.0, 3.0], "c"), "2 * c * c - c + 3"), ("chebval", lambda: poly.chebval([1.0, 2.0, 3.0], "c"), "1 + 2 * c + 3 * (2 * c * c - 1)"), ("legval", lambda: poly.legval([1.0, 2.0, 3.0], "c"), "1 + 2 * c + 3 * (1.5 * c * c - 0.5)"),
    ("hermval", lambda: poly.hermval([1.0, 2.0, 3.0], "c"), "1 + 4 * c + 3 * (4 * c * c - 2)"), ("lagval", lambda: poly.lagval([1.0, 2.0, 3.0], "c"), "1 + 2 * (1 - c) + 3 * (1 - 2 * c + c * c / 2)"),
    ("masked_invalid", lambda: masked.masked_invalid(u.log("b")), "CASE WHEN b > 0 THEN ln(abs(b) + CASE WHEN b = 0 THEN 1 ELSE 0 END) END"), ("masked_greater", lambda: masked.masked_greater("a", 0.0), "CASE WHEN a <= 0 THEN a END"), ("masked_less_equal", lambda: masked.masked_less_equal("a", 0.0), "CASE WHEN a > 0 THEN a END"),
    ("masked_equal", lambda: masked.masked_equal("b", 0.0), "nullif(b, 0.0)"), ("masked_divide", lambda: masked.divide("a", "b"), "a / nullif(b, 0)"),
    ("symbolic_column", lambda: symbolic.Expr.parse("a*c + 2*b^2 - p/3").column(), "a * c + 2 * b * b - p / 3"), ("symbolic_derivative", lambda: symbolic.Expr.parse("sin(c)*c^2").diff("c").column(), "cos(c) * c * c + 2 * c * sin(c)"),
):
    _ufunc(_name, _f, _sql, 8 if _name in ("multiply", "mod", "remainder", "fmod", "power", "float_power", "complex_real", "complex_imag", "symbolic_column", "maximum", "minimum", "fmax", "fmin") else 6)  # exact products end within eight digits
for _name, _f, _sql in (
    ("isnan", lambda: u.isnan(u.sqrt("a")), "a < 0"), ("isinf", lambda: u.isinf(u.log("b")), "b = 0"), ("isfinite", lambda: u.isfinite(u.log("b")), "b > 0"), ("is_close", lambda: u.is_close("a", F.col("a") * 1.00001, rtol=1.5e-5), "abs(a - a * 1.00001) <= 1e-8 + 1.5e-5 * abs(a * 1.00001)"),
    ("equal", lambda: u.equal(u.sqrt("b"), u.sqrt("b")), "b >= 0"), ("not_equal", lambda: u.not_equal("b", F.lit(1.0)), "b <> 1"), ("greater", lambda: u.greater("a", "b"), "a > b"), ("greater_equal", lambda: u.greater_equal("b", F.lit(1.0)), "b >= 1"), ("less", lambda: u.less("a", "b"), "a < b"), ("less_equal", lambda: u.less_equal("b", F.lit(1.0)), "b <= 1"),
    ("logical_not", lambda: u.logical_not("b"), "b = 0"), ("logical_and", lambda: u.logical_and("b", "c"), "b <> 0 AND c <> 0"), ("logical_or", lambda: u.logical_or("b", "c"), "b <> 0 OR c <> 0"), ("logical_xor", lambda: u.logical_xor("b", "c"), "(b <> 0) <> (c <> 0)"),
    ("bitwise_and", lambda: u.bitwise_and("i", "j"), "i & j"), ("bitwise_or", lambda: u.bitwise_or("i", "j"), "i | j"), ("bitwise_xor", lambda: u.bitwise_xor("i", "j"), "xor(i, j)"), ("invert", lambda: u.invert("i"), "~i"), ("left_shift", lambda: u.left_shift("i", "j"), "i << j"), ("right_shift", lambda: u.right_shift("i", "j"), "i >> j"),
    ("gcd", lambda: u.gcd("i", "j"), "gcd(i, j)"), ("lcm", lambda: u.lcm("i", "j"), "lcm(i, j)"), ("int_floor_divide", lambda: u.floor_divide(-F.col("i"), "j", whole=True), "CAST(floor(-i / j) AS BIGINT)"), ("int_remainder", lambda: u.remainder(-F.col("i"), "j", whole=True), "((-i) % j + j) % j"), ("int_power", lambda: u.int_power(F.col("j"), F.lit(3)), "j * j * j"), ("wrapping_multiply", lambda: u.wrapping("multiply", "i", "j"), "i * j"),
    ("digitize", lambda: order.in_edges(F.col("a"), [-100.0, 0.0, 50.0, 120.0]), "CAST((a >= -100) AS INT) + (a >= 0)::INT + (a >= 50)::INT + (a >= 120)::INT"), ("digitize_right", lambda: order.in_edges(F.col("b"), [-2.0, 0.0, 2.0], True), "(b > -2)::INT + (b > 0)::INT + (b > 2)::INT"),
):
    _ufunc(_name, _f, _sql, None)


# reductions: of all cells, and by the return flag as an axis
_L = "SELECT l_returnflag AS g, l_extendedprice AS v, l_quantity AS w, l_discount AS d FROM lineitem"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("d"))


for _name, _agg, _sql in (
    ("sum", lambda: red.agg_sum(), "sum(v)"), ("prod", lambda: red.agg_prod(1 + F.col("d") / 1e6), "product(1 + d / 1e6)"), ("mean", lambda: red.agg_mean(), "avg(v)"), ("std", lambda: red.agg_std(), "stddev_pop(v)"), ("variance", lambda: red.agg_variance(ddof=1), "var_samp(v)"),
    ("min", lambda: red.agg_min(), "min(v)"), ("max", lambda: red.agg_max(), "max(v)"), ("ptp", lambda: red.agg_ptp(), "max(v) - min(v)"), ("all", lambda: red.agg_all("d").cast("int"), "min((d <> 0)::INT)"), ("any", lambda: red.agg_any("d").cast("int"), "max((d <> 0)::INT)"),
    ("count_nonzero", lambda: red.agg_count_nonzero("d"), "count(*) FILTER (d <> 0)"), ("average", lambda: red.agg_average(), "sum(v * w) / sum(w)"), ("median", lambda: red.agg_median(), "quantile_cont(v, 0.5)"),
    ("nansum", lambda: red.agg_nansum(F.when(F.col("d") == 0, F.lit(float("nan"))).otherwise(F.col("v"))), "sum(v) FILTER (d <> 0)"), ("nanmean", lambda: red.agg_nanmean(F.when(F.col("d") == 0, F.lit(float("nan"))).otherwise(F.col("v"))), "avg(v) FILTER (d <> 0)"),
    ("nanvar", lambda: red.agg_nanvar(F.when(F.col("d") == 0, F.lit(float("nan"))).otherwise(F.col("w"))), "var_pop(w) FILTER (d <> 0)"), ("nanstd", lambda: red.agg_nanstd(F.when(F.col("d") == 0, F.lit(float("nan"))).otherwise(F.col("w"))), "stddev_pop(w) FILTER (d <> 0)"),
    ("nanmin", lambda: red.agg_nanmin(F.when(F.col("d") == 0, F.lit(float("nan"))).otherwise(F.col("v"))), "min(v) FILTER (d <> 0)"), ("nanmax", lambda: red.agg_nanmax(F.when(F.col("d") == 0, F.lit(float("nan"))).otherwise(F.col("v"))), "max(v) FILTER (d <> 0)"),
    ("norm", lambda: F.sqrt(F.sum(F.col("w") * F.col("w"))), "sqrt(sum(w * w))"), ("npv", lambda: F.sum(F.col("d") / F.pow(F.lit(1.05), F.col("w"))), "sum(d / pow(1.05, w))"), ("reduce_logaddexp", lambda: red.agg_logaddexp(F.col("w")), "max(w) + ln(sum(exp(w - 50))) - (max(w) - 50)"),
    ("reduce_bitwise_xor", lambda: red.REDUCERS["bitwiseXor"](F.col("w").cast("bigint")).cast("double"), "bit_xor(CAST(w AS BIGINT))::DOUBLE"), ("reduce_gcd", lambda: red.REDUCERS["gcd"](F.col("w") * 6).cast("double"), "max(6.0)::DOUBLE"),
    ("masked_sum", lambda: F.sum(F.when(F.col("d") > 0.05, F.col("v"))), "sum(v) FILTER (d > 0.05)"), ("masked_count", lambda: F.count(F.when(F.col("d") > 0.05, F.col("v"))).cast("double"), "count(*) FILTER (d > 0.05)::DOUBLE"),
):
    QUERIES[f"{_name}_axis"] = lambda spark, sf_dir, f=_agg: _lines(spark, sf_dir).groupBy("g").agg(F.round(f(), 4).alias("v"))
    ORACLES[f"{_name}_axis"] = f"SELECT g, round({_sql}, 4) AS v FROM ({_L}) GROUP BY g"
    QUERIES[f"{_name}_all"] = lambda spark, sf_dir, f=_agg: _lines(spark, sf_dir).agg(F.round(f(), 4).alias("v"))
    ORACLES[f"{_name}_all"] = f"SELECT round({_sql}, 4) AS v FROM ({_L})"

_H = "SELECT l_extendedprice AS v FROM lineitem"


@query("histogram", f"""WITH x AS ({_H}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
 h AS (SELECT CAST(least(floor((v - lo) * 10 / (hi - lo)), 9) AS INT) AS b, count(*) AS n FROM x, e GROUP BY 1)
 SELECT CAST(r.range AS INT) AS bin, round(lo + r.range * (hi - lo) / 10, 4) AS "left", round(lo + (r.range + 1) * (hi - lo) / 10, 4) AS "right", coalesce(n, 0) AS v
 FROM range(10) r CROSS JOIN e LEFT JOIN h ON h.b = r.range""")  # fmt: skip
def histogram(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v"))
    return order.histogram(x, "v").select("bin", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), "v")


@query("histogram_edges", "SELECT b AS bin, count(v) AS v FROM (VALUES (0, 0.0, 10.0), (1, 10.0, 25.0), (2, 25.0, 50.0)) e(b, lo, hi) LEFT JOIN (SELECT l_quantity AS v FROM lineitem) ON v >= lo AND (v < hi OR (hi = 50 AND v = 50)) GROUP BY b")
def histogram_edges(spark, sf_dir):
    return order.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [0.0, 10.0, 25.0, 50.0]).select("bin", "v")


@query("bincount", "SELECT r.range AS bin, count(p_size) AS v FROM range((SELECT max(p_size) + 1 FROM part)) r LEFT JOIN part ON p_size = r.range GROUP BY r.range")
def bincount(spark, sf_dir):
    return order.bincount(table(spark, sf_dir, "part"), "p_size")


for _m, _sql in (("linear", "quantile_cont(v, 0.35)"), ("invertedCdf", "quantile_disc(v, 0.35)")):
    QUERIES[f"quantile_{_m}"] = lambda spark, sf_dir, m=_m: red.quantile(_lines(spark, sf_dir), "v", 0.35, m, ("g",)).select("g", F.round("v", 6).alias("v"))
    ORACLES[f"quantile_{_m}"] = f"SELECT g, round({_sql}, 6) AS v FROM ({_L}) GROUP BY g"
_Q = {
    "hazen": ("0.35 * n - 0.5", "lin"), "weibull": ("0.35 * (n + 1) - 1", "lin"), "medianUnbiased": ("0.35 * (n + 1 / 3.0) + 1 / 3.0 - 1", "lin"), "normalUnbiased": ("0.35 * (n + 0.25) + 0.375 - 1", "lin"),
    "interpolatedInvertedCdf": ("0.35 * n - 1", "lin"), "lower": ("0.35 * (n - 1)", "0"), "higher": ("0.35 * (n - 1)", "CASE WHEN g0 > 0 THEN 1 ELSE 0 END"), "midpoint": ("0.35 * (n - 1)", "CASE WHEN g0 > 0 THEN 0.5 ELSE 0 END"),
    "nearest": ("0.35 * (n - 1)", "CASE WHEN g0 > 0.5 OR (g0 = 0.5 AND j % 2 = 1) THEN 1 ELSE 0 END"), "averagedInvertedCdf": ("0.35 * n - 1", "CASE WHEN g0 > 0 THEN 1 ELSE 0.5 END"), "closestObservation": ("0.35 * n - 1.5", "CASE WHEN g0 > 0 OR j % 2 = 0 THEN 1 ELSE 0 END"),
}
for _m, (_i, _w) in _Q.items():
    QUERIES[f"quantile_{_m}"] = lambda spark, sf_dir, m=_m: red.quantile(_lines(spark, sf_dir), "v", 0.35, m, ("g",)).select("g", F.round("v", 6).alias("v"))
    ORACLES[f"quantile_{_m}"] = f"""WITH x AS (SELECT g, list_sort(list(v)) AS s, count(*) AS n FROM ({_L}) GROUP BY g), y AS (SELECT *, round({_i}, 9) AS vi FROM x),
 z AS (SELECT *, CAST(floor(vi) AS BIGINT) AS j, vi - floor(vi) AS g0 FROM y), w AS (SELECT *, {"g0" if _w == "lin" else _w} AS q FROM z)
 SELECT g, round(s[j + 1] * (1 - q) + s[j + 2] * q, 6) AS v FROM w"""


# sorting, searching and sets
@query("sort", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i0, o_totalprice AS v FROM orders")
def sort(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return order.global_rank(o.select("o_totalprice", "o_orderkey"), [F.col("o_totalprice"), F.col("o_orderkey")], "i0").select("i0", F.col("o_totalprice").alias("v"))


@query("argsort", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i0, o_orderkey AS v FROM orders")
def argsort(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return order.global_rank(o.select("o_totalprice", "o_orderkey"), [F.col("o_totalprice"), F.col("o_orderkey")], "i0").select("i0", F.col("o_orderkey").alias("v"))


@query("argmax", "SELECT arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS hi, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS lo FROM orders")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(red.agg_argmax("o_orderkey", "o_totalprice").alias("hi"), red.agg_argmin("o_orderkey", "o_totalprice").alias("lo"))


@query("unique", "SELECT p_size AS v, min(p_partkey) AS first, count(*) AS n, dense_rank() OVER (ORDER BY p_size) - 1 AS i0 FROM part GROUP BY p_size")
def unique(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("v")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    return order.global_rank(p, [F.col("v")], "i0")


@query("searchsorted", "SELECT c_custkey AS k, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS lo, (SELECT count(*) FROM supplier WHERE s_acctbal <= c_acctbal) AS hi FROM customer")
def searchsorted(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    lo = order.searchsorted(s, c, "s_acctbal", "c_acctbal", "left", "lo")
    return order.searchsorted(s, lo, "s_acctbal", "c_acctbal", "right", "hi").select("k", "lo", "hi")


@query("interp", """WITH k AS (SELECT s_acctbal AS x, avg(s_suppkey) AS y FROM supplier GROUP BY 1), e AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(y, x) AS yl, arg_max(y, x) AS yh FROM k),
 s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM k)
 SELECT c_custkey AS k, round(CASE WHEN c_acctbal <= lo THEN yl WHEN c_acctbal >= hi THEN yh ELSE y + (y2 - y) * (c_acctbal - x) / (x2 - x) END, 6) AS v
 FROM customer CROSS JOIN e ASOF LEFT JOIN s ON c_acctbal >= s.x""")  # fmt: skip
def interp(spark, sf_dir):
    knots = table(spark, sf_dir, "supplier").groupBy(F.col("s_acctbal").alias("xp")).agg(F.avg("s_suppkey").alias("fp"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    return order.interp(c, knots).select("k", F.round("v", 6).alias("v"))


def _vectors(spark, sf_dir):
    part = lambda t, c: SparkArray(table(spark, sf_dir, t).select(F.monotonically_increasing_id().alias("i0"), F.col(c).cast("bigint").alias("v")), (1,), "int64")
    return part("part", "p_size"), part("lineitem", "l_quantity")


for _name, _op in (("intersect1d", "INTERSECT"), ("union1d", "UNION"), ("setdiff1d", "EXCEPT")):
    QUERIES[_name] = lambda spark, sf_dir, n=_name: getattr(order, n)(_vectors(spark, sf_dir)[0].map(lambda v: v + 10), _vectors(spark, sf_dir)[1]).df
    ORACLES[_name] = f"SELECT row_number() OVER (ORDER BY v) - 1 AS i0, v FROM (SELECT p_size + 10 AS v FROM part {_op} SELECT CAST(l_quantity AS BIGINT) FROM lineitem)"


@query("setxor1d", "WITH a AS (SELECT DISTINCT p_size + 10 AS v FROM part), b AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS v FROM lineitem) SELECT row_number() OVER (ORDER BY v) - 1 AS i0, v FROM ((SELECT v FROM a EXCEPT SELECT v FROM b) UNION (SELECT v FROM b EXCEPT SELECT v FROM a))")
def setxor1d(spark, sf_dir):
    a, b = _vectors(spark, sf_dir)
    return order.setxor1d(a.map(lambda v: v + 10), b).df


@query("isin", "SELECT o_orderkey AS i0, o_custkey IN (SELECT s_suppkey FROM supplier) AS v FROM orders")
def isin(spark, sf_dir):
    o = SparkArray(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i0"), F.col("o_custkey").cast("bigint").alias("v")), (1,), "int64")
    s = SparkArray(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i0"), F.col("s_suppkey").cast("bigint").alias("v")), (1,), "int64")
    return order.isin(o, s).df


# scans over events in the order of their id
def _events(spark, sf_dir) -> SparkArray:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("i0"), F.col("value").cast("double").alias("v"))
    ends = e.agg(F.min("i0").alias("a"), F.max("i0").alias("b")).head()
    return SparkArray(e.withColumn("i0", F.col("i0") - ends["a"]), (ends["b"] - ends["a"] + 1,))


_E = "SELECT event_id - (SELECT min(event_id) FROM events) AS i0, value AS v FROM events"
for _name, _sql in (("cumsum", "sum(v)"), ("cummin", "min(v)"), ("cummax", "max(v)")):
    QUERIES[_name] = lambda spark, sf_dir, k=_name[3:]: scans.cumulative(_events(spark, sf_dir), k).df.select("i0", F.round("v", 3).alias("v"))
    ORACLES[_name] = f"SELECT i0, round({_sql} OVER (ORDER BY i0), 3) AS v FROM ({_E})"


@query("cumprod", f"SELECT i0, round(exp(sum(ln(1 + v / 1e6)) OVER (ORDER BY i0)), 6) AS v FROM ({_E})")
def cumprod(spark, sf_dir):
    return scans.cumulative(_events(spark, sf_dir).map(lambda v: 1 + v / 1e6), "prod").df.select("i0", F.round("v", 6).alias("v"))


@query("diff", f"SELECT i0, round(w - v, 6) AS v FROM (SELECT i0, v, lead(v) OVER (ORDER BY i0) AS w FROM ({_E})) WHERE w IS NOT NULL")
def diff(spark, sf_dir):
    return scans.diff(_events(spark, sf_dir)).df.select("i0", F.round("v", 6).alias("v"))


@query("gradient", f"SELECT i0, round(CASE WHEN p IS NULL THEN n - v WHEN n IS NULL THEN v - p ELSE (n - p) / 2 END, 5) AS v FROM (SELECT i0, v, lead(v) OVER w AS n, lag(v) OVER w AS p FROM ({_E}) WINDOW w AS (ORDER BY i0))")
def gradient(spark, sf_dir):
    return scans.gradient(_events(spark, sf_dir)).df.select("i0", F.round("v", 5).alias("v"))


@query("trapz", f"SELECT round(sum((v + w) / 2), 3) AS v FROM (SELECT v, lead(v) OVER (ORDER BY i0) AS w FROM ({_E})) WHERE w IS NOT NULL")
def trapz(spark, sf_dir):
    return scans.trapz(_events(spark, sf_dir)).df.select(F.round("v", 3).alias("v"))


@query("unwrap", f"SELECT i0, round(i0 * 2.5::DOUBLE, 6) AS v FROM ({_E})")
def unwrap(spark, sf_dir):
    e = _events(spark, sf_dir)
    return scans.unwrap(SparkArray(e.df.select("i0", (F.col("i0") * 2.5 - 2 * math.pi * F.floor(F.col("i0") * 2.5 / (2 * math.pi))).alias("v")), e.shape)).df.select("i0", F.round("v", 6).alias("v"))


@query("roll", f"WITH e AS ({_E}) SELECT (i0 + 3) % (SELECT count(*) FROM e) AS i0, v FROM e")
def roll(spark, sf_dir):
    return _events(spark, sf_dir).roll(3).df


@query("sliding_window", f"SELECT i0, round(s, 4) AS v FROM (SELECT i0, sum(v) OVER (ORDER BY i0 ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s, count(*) OVER (ORDER BY i0 ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c FROM ({_E})) WHERE c = 5")
def sliding_window(spark, sf_dir):
    return red.reduce(scans.sliding_windows(_events(spark, sf_dir), 5), "sum", 1).df.select("i0", F.round("v", 4).alias("v"))


@query("convolve", f"SELECT i0, round(0.25 * v + 0.5 * p + 0.25 * q, 6) AS v FROM (SELECT i0, v, lag(v) OVER w AS p, lag(v, 2) OVER w AS q FROM ({_E}) WINDOW w AS (ORDER BY i0)) WHERE q IS NOT NULL")
def convolve(spark, sf_dir):
    kernel = SparkArray.of(spark, [0.25, 0.5, 0.25])
    return con.convolve(_events(spark, sf_dir), kernel, "valid").df.select((F.col("i0") + 2).alias("i0"), F.round("v", 6).alias("v"))


@query("reduceat", f"SELECT CAST(g AS BIGINT) AS i0, round(sum(v), 4) AS v FROM (SELECT v, CASE WHEN i0 < 10 THEN 0 WHEN i0 < 100 THEN 1 ELSE 2 END AS g FROM ({_E})) GROUP BY 1")
def reduceat(spark, sf_dir):
    return red.reduceat(_events(spark, sf_dir), [0, 10, 100], "add").df.select("i0", F.round("v", 4).alias("v"))


@query("at", f"WITH e AS ({_E}) SELECT i0, round(v + coalesce(c, 0), 6) AS v FROM e LEFT JOIN (SELECT i0 % 50 AS j, count(*) * 1.0 AS c FROM e GROUP BY 1) ON i0 = j")
def at(spark, sf_dir):
    e = _events(spark, sf_dir)
    return red.at(e, e.map(lambda v: F.lit(0).cast("bigint"), "int64").map(lambda v: v).__class__(e.df.select("i0", (F.col("i0") % 50).alias("v")), e.shape, "int64"), e.map(lambda v: F.lit(1.0)), "add").df.select("i0", F.round("v", 6).alias("v"))


@query("find_index", f"SELECT min(i0) AS v FROM ({_E}) WHERE v > 400")
def find_index(spark, sf_dir):
    at_ = order.find_index(_events(spark, sf_dir), "gt", 400.0)
    return spark.range(1).select(F.lit(at_[0] if at_ else None).cast("bigint").alias("v"))


# N-dimensional: embeddings as a matrix of vec_id x component
def _matrix(spark, sf_dir) -> SparkArray:
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max("vec_id").alias("n")).head()["n"] + 1
    return SparkArray.packed(e, "vec_id", "embedding", n, 64)


_M = "SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
for _name, _f, _sql in (
    ("transpose", lambda m: m.transpose(), "SELECT i1 AS i0, i0 AS i1, v FROM m"), ("slice", lambda m: m[[slice(10, 50, 5), slice(None, None, -1)]], "SELECT CAST((i0 - 10) / 5 AS BIGINT) AS i0, 63 - i1 AS i1, v FROM m WHERE i0 >= 10 AND i0 < 50 AND (i0 - 10) % 5 = 0"),
    ("flip", lambda m: m.flip(1), "SELECT i0, 63 - i1 AS i1, v FROM m"), ("reshape", lambda m: m.reshape(-1, 32), "SELECT i0 * 2 + i1 // 32 AS i0, i1 % 32 AS i1, v FROM m"), ("flatten", lambda m: m.flatten(), "SELECT i0 * 64 + i1 AS i0, v FROM m"),
    ("take", lambda m: m.take([5, 3, 3], 0), "SELECT x.k AS i0, i1, v FROM m JOIN (VALUES (0, 5), (1, 3), (2, 3)) x(k, j) ON i0 = j"), ("tril", lambda m: shaping.tril(m), "SELECT i0, i1, CASE WHEN i1 <= i0 THEN v ELSE 0 END AS v FROM m"), ("triu", lambda m: shaping.triu(m), "SELECT i0, i1, CASE WHEN i1 >= i0 THEN v ELSE 0 END AS v FROM m"),
    ("diagonal", lambda m: shaping.diagonal(m), "SELECT i0, v FROM m WHERE i0 = i1"),

    ("split", lambda m: shaping.split(m, 2, 1)[1], "SELECT i0, i1 - 32 AS i1, v FROM m WHERE i1 >= 32"),
    ("sort_rows", lambda m: order.sort(m), "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, v FROM m"), ("cumsum_rows", lambda m: scans.cumulative(m, "sum", 1).map(lambda v: F.round(v, 5)), "SELECT i0, i1, round(sum(v) OVER (PARTITION BY i0 ORDER BY i1), 5) AS v FROM m"),

    ("matmul", lambda m: con.matmul(m.transpose(), m).map(lambda v: F.round(v, 5)), "SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 5) AS v FROM m a JOIN m b USING (i0) GROUP BY 1, 2"), ("einsum", lambda m: con.einsum("ij,ij->i", m, m).map(lambda v: F.round(v, 5)), "SELECT i0, round(sum(v * v), 5) AS v FROM m GROUP BY i0"),
    ("tensordot", lambda m: con.tensordot(m, m, ([1], [1])).map(lambda v: F.round(v, 5)), "SELECT a.i0 AS i0, b.i0 AS i1, round(sum(a.v * b.v), 5) AS v FROM m a JOIN m b USING (i1) GROUP BY 1, 2"),


    ("norm_rows", lambda m: red.norm(m, None, 1).map(lambda v: F.round(v, 5)), "SELECT i0, round(sqrt(sum(v * v)), 5) AS v FROM m GROUP BY i0"), ("argmax_rows", lambda m: red.arg_reduce(m, "argmax", 1), "SELECT i0, arg_max(i1, (v, -i1)) AS v FROM m GROUP BY i0"), ("broadcast", lambda m: (m - red.reduce(m, "mean", 0)).map(lambda v: F.round(v, 5)), "SELECT i0, i1, round(v - avg(v) OVER (PARTITION BY i1), 5) AS v FROM m"),
    ("trace", lambda m: red.trace(m).map(lambda v: F.round(v, 5)), "SELECT round(sum(v), 5) AS v FROM m WHERE i0 = i1"), ("cov", lambda m: red.cov(m, rowvar=False).map(lambda v: F.round(v, 6)), "SELECT a.i1 AS i0, b.i1 AS i1, round(covar_samp(a.v, b.v), 6) AS v FROM m a JOIN m b USING (i0) GROUP BY 1, 2"), ("corrcoef", lambda m: red.corrcoef(m, rowvar=False).map(lambda v: F.round(v, 6)), "SELECT a.i1 AS i0, b.i1 AS i1, round(corr(a.v, b.v), 6) AS v FROM m a JOIN m b USING (i0) GROUP BY 1, 2"),
    ("argwhere", lambda m: order.argwhere((m > 2.5).astype("int64")), "SELECT row_number() OVER (PARTITION BY k ORDER BY i0, i1) - 1 AS i0, k AS i1, CASE k WHEN 0 THEN i0 ELSE i1 END AS v FROM m, (VALUES (0::BIGINT), (1)) x(k) WHERE v > 2.5"), ("apply_mask", lambda m: m[m > 2.5], "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, v FROM m WHERE v > 2.5"),
    ("softmax", lambda m: _softmax(m).map(lambda v: F.round(v, 6)), "SELECT i0, i1, round(exp(v) / sum(exp(v)) OVER (PARTITION BY i0), 6) AS v FROM m"), ("take_along_axis", lambda m: order.take_along_axis(m, order.argsort(m, 1)[:, :3], 1), "SELECT i0, i1, v FROM (SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, v FROM m) WHERE i1 < 3"),
    ("cross", lambda m: con.cross(m[:, :3], m[:, 3:6]).map(lambda v: F.round(v, 6)), "SELECT vec_id AS i0, CAST(k AS BIGINT) AS i1, round(e[(k + 1) % 3 + 1] * e[(k + 2) % 3 + 4] - e[(k + 2) % 3 + 1] * e[(k + 1) % 3 + 4], 6) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), (VALUES (0), (1), (2)) x(k)"),
    ("masked_mean_axis", lambda m: masked.MaskedArray(m, m > 1.0).mean(0).data.map(lambda v: F.round(v, 6)), "SELECT i1 AS i0, round(avg(v) FILTER (v <= 1), 6) AS v FROM m GROUP BY i1"), ("masked_compressed", lambda m: masked.MaskedArray(m, m <= 2.5).compressed(), "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, v FROM m WHERE v > 2.5"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(_matrix(spark, sf_dir)).df
    ORACLES[_name] = f"WITH m AS ({_M}) {_sql}"


# operators of pairs of rows take the rows with a vec_id divisible by 100 against all, pdist all pairs
_N = "(SELECT max(vec_id) + 1 FROM embeddings)"
_QUERY = "(SELECT i0 // 100 AS i0, i1, v FROM m WHERE i0 % 100 = 0)"
for _name, _f, _sql in (
    ("concatenate", lambda m: shaping.concatenate([m, m]), f"SELECT i0, i1, v FROM m UNION ALL SELECT i0 + {_N}, i1, v FROM m"), ("stack", lambda m: shaping.stack([m, m.flip(1)]), "SELECT 0::BIGINT AS i0, i0 AS i1, i1 AS i2, v FROM m UNION ALL SELECT 1, i0, 63 - i1, v FROM m"),
    ("tile", lambda m: shaping.tile(m, [2, 1]), f"SELECT i0 + {_N} * r AS i0, i1, v FROM m, (VALUES (0), (1)) x(r)"), ("repeat", lambda m: shaping.repeat(m, 2, 0), "SELECT i0 * 2 + r AS i0, i1, v FROM m, (VALUES (0), (1)) x(r)"),
    ("pad", lambda m: shaping.pad(m, [(1, 0), (0, 0)], "edge"), "SELECT i0 + 1 AS i0, i1, v FROM m UNION ALL SELECT 0, i1, v FROM m WHERE i0 = 0"), ("put", lambda m: m.put([slice(None), 1], 9.0), "SELECT i0, i1, CASE WHEN i1 = 1 THEN 9.0 ELSE v END AS v FROM m"), ("rot90", lambda m: m.rot90(), "SELECT 63 - i1 AS i0, i0 AS i1, v FROM m"),
    ("outer", lambda m: con.outer(m[[slice(None, None, 100), 0]], m[[slice(None), 1]]).map(lambda v: F.round(v, 6)), f"SELECT a.i0, b.i0 AS i1, round(a.v * b.v, 6) AS v FROM {_QUERY} a, m b WHERE a.i1 = 0 AND b.i1 = 1"),
    ("kron", lambda m: con.kron(m[::100, :2], m[:, :2]).map(lambda v: F.round(v, 6)), f"SELECT a.i0 * {_N} + b.i0 AS i0, a.i1 * 2 + b.i1 AS i1, round(a.v * b.v, 6) AS v FROM {_QUERY} a, m b WHERE a.i1 < 2 AND b.i1 < 2"),
    ("inner", lambda m: con.inner(m[::100], m).map(lambda v: F.round(v, 5)), f"SELECT a.i0, b.i0 AS i1, round(sum(a.v * b.v), 5) AS v FROM {_QUERY} a JOIN m b USING (i1) GROUP BY 1, 2"),
    ("multi_dot", lambda m: con.multi_dot([m, m.transpose(), m]).map(lambda v: F.round(v, 4)), "SELECT a.i0, g.y AS i1, round(sum(a.v * g.v), 4) AS v FROM m a JOIN (SELECT b.i1 AS x, c.i1 AS y, sum(b.v * c.v) AS v FROM m b JOIN m c USING (i0) GROUP BY 1, 2) g ON a.i1 = g.x GROUP BY 1, 2"),
    ("cdist", lambda m: con.cdist(m[::100], m).map(lambda v: F.round(v, 5)), f"SELECT a.i0, b.i0 AS i1, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 5) AS v FROM {_QUERY} a JOIN m b USING (i1) GROUP BY 1, 2"),
    ("pdist", lambda m: con.pdist(m, "chebyshev").map(lambda v: F.round(v, 5)), f"SELECT {_N} * a.i0 - a.i0 * (a.i0 + 1) // 2 + b.i0 - a.i0 - 1 AS i0, round(max(abs(a.v - b.v)), 5) AS v FROM m a JOIN m b USING (i1) WHERE a.i0 < b.i0 GROUP BY a.i0, b.i0"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(_matrix(spark, sf_dir)).df
    ORACLES[_name] = f"WITH m AS ({_M}) {_sql}"


def _softmax(m: SparkArray) -> SparkArray:
    from .plans.nn import softmax

    return softmax(m)


def _gram(m: SparkArray) -> SparkArray:
    """The square matrix of every row of ``m``: the sums of products of its columns."""
    return con.matmul(m.transpose(), m)


# transforms: each row's sums of products with the roots of unity, in SQL
def _parts(a: SparkArray) -> DataFrame:
    """Real and imaginary parts, without negative zeros."""
    return a.df.select(*a.index, (F.round("v.re", 5) + 0.0).alias("re"), (F.round("v.im", 5) + 0.0).alias("im"))


def _real(a: SparkArray, digits: int = 5) -> DataFrame:
    return a.map(lambda v: F.round(v, digits) + 0.0).df


def _complex(m: SparkArray) -> SparkArray:
    """The matrix with its mirror image as imaginary part."""
    return m.binary(m.flip(1), u.complex, "complex128")


_TURN = "2 * pi() * ((i1 * k) % 64) / 64"
_DFT = f"SELECT i0, k AS i1, sum(v * cos({_TURN})) AS re, -sum(v * sin({_TURN})) AS im FROM m, range(64) x(k) GROUP BY 1, 2"
_TURN_DOWN = f"2 * pi() * ((i0 * k) % {_N}) / {_N}"
for _name, _f, _sql in (
    ("fft", lambda m: _parts(ker.fft(m)), f"SELECT i0, i1, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({_DFT})"),
    ("ifft", lambda m: _parts(ker.ifft(m)), f"SELECT i0, i1, round(re / 64, 5) + 0.0 AS re, round(-im / 64, 5) + 0.0 AS im FROM ({_DFT})"),
    ("rfft", lambda m: _parts(ker.rfft(m)), f"SELECT i0, i1, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({_DFT}) WHERE i1 <= 32"),
    ("irfft", lambda m: _real(ker.irfft(ker.rfft(m))), "SELECT i0, i1, round(v, 5) + 0.0 AS v FROM m"),
    ("fft2", lambda m: _parts(ker.fft2(m)), f"""SELECT k AS i0, i1, round(sum(re * cos({_TURN_DOWN}) + im * sin({_TURN_DOWN})), 5) + 0.0 AS re,
 round(sum(im * cos({_TURN_DOWN}) - re * sin({_TURN_DOWN})), 5) + 0.0 AS im FROM ({_DFT}), range({_N}) x(k) GROUP BY 1, 2"""),
    ("complex_matmul", lambda m: _parts(con.matmul(_complex(m).transpose(), _complex(m))), """SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v - a.w * b.w), 5) + 0.0 AS re, round(sum(a.v * b.w + a.w * b.v), 5) + 0.0 AS im
 FROM z a JOIN z b USING (i0) GROUP BY 1, 2"""),
    ("complex_sum", lambda m: _parts(red.reduce(_complex(m), "sum", 0)), "SELECT i1 AS i0, round(sum(v), 5) + 0.0 AS re, round(sum(w), 5) + 0.0 AS im FROM z GROUP BY i1"),
    ("complex_mean", lambda m: _parts(red.reduce(_complex(m), "mean", 1, True)), "SELECT i0, 0::BIGINT AS i1, round(avg(v), 5) + 0.0 AS re, round(avg(w), 5) + 0.0 AS im FROM z GROUP BY i0"),
    ("complex_einsum", lambda m: _parts(con.einsum("ij,ij->i", _complex(m), m)), "SELECT i0, round(sum(v * v), 5) + 0.0 AS re, round(sum(w * v), 5) + 0.0 AS im FROM z GROUP BY i0"),
    ("fftshift", lambda m: ker.fftshift(m, 1).df, "SELECT i0, (i1 + 32) % 64 AS i1, v FROM m"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(_matrix(spark, sf_dir))
    ORACLES[_name] = f"WITH m AS ({_M}), z AS (SELECT a.i0, a.i1, a.v, b.v AS w FROM m a JOIN m b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1) {_sql}"


# decompositions of the whole matrix or of its mean product of columns (g): what their factors give when multiplied, in SQL
def _mean_gram(m: SparkArray) -> SparkArray:
    return _gram(m).map(lambda v: v / m.shape[0])


def _rebuilt_svd(m: SparkArray) -> SparkArray:
    _, s, v = ker.svd(m)
    scaled = v * s.reshape(-1, 1)
    return con.matmul(scaled.transpose(), scaled).map(lambda v: v / m.shape[0])


def _rebuilt_qr(m: SparkArray) -> SparkArray:
    r = ker.qr(m)[1]
    return con.matmul(r.transpose(), r).map(lambda v: v / m.shape[0])


def _rebuilt_eigh(m: SparkArray) -> SparkArray:
    w, v = ker.eigh(_mean_gram(m))
    return con.matmul(v * w.reshape(1, -1), v.transpose())


def _rebuilt_cholesky(m: SparkArray) -> SparkArray:
    low = ker.cholesky(_mean_gram(m))
    return con.matmul(low, low.transpose())


def _rebuilt_hessenberg(m: SparkArray) -> SparkArray:
    h, q = ker.hessenberg(_mean_gram(m))
    return con.multi_dot([q, h, q.transpose()])


def _fitted(m: SparkArray) -> SparkArray:
    """The normal equations' left side at the least-squares solution of the last column by the others."""
    x = ker.lstsq(m[:, :63], m[:, 63])[0]
    return con.matmul(con.matmul(m[:, :63].transpose(), m[:, :63]), x)


def _moments(values: SparkArray) -> DataFrame:
    return values.df.agg(F.round(F.sum("v.re"), 5).alias("s1"), F.round(F.sum(F.col("v.re") * F.col("v.re")), 5).alias("s2"))


_G = f"m AS ({_M}), g AS (SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) / {_N} AS v FROM m a JOIN m b USING (i0) GROUP BY 1, 2)"
_GRAM_SQL = "SELECT i0, i1, round(v, 6) + 0.0 AS v FROM g"
_MOMENTS_SQL = "SELECT round(sum(v) FILTER (i0 = i1), 5) AS s1, round(sum(v * v), 5) AS s2 FROM g"
#: Gaussian elimination without exchanges, as the matrix is positive definite: step k leaves the rows and columns beyond it.
_PIVOTS = """p(k, i, j, v) AS (SELECT 0::BIGINT, i0, i1, v FROM g UNION ALL
 SELECT a.k + 1, a.i, a.j, a.v - b.v * c.v / d.v FROM p a JOIN p b ON b.i = a.i AND b.j = a.k JOIN p c ON c.i = a.k AND c.j = a.j JOIN p d ON d.i = a.k AND d.j = a.k
 WHERE a.i > a.k AND a.j > a.k)"""
for _name, _f, _sql in (
    ("qr", lambda m: _real(_rebuilt_qr(m), 6), _GRAM_SQL), ("svd", lambda m: _real(_rebuilt_svd(m), 6), _GRAM_SQL), ("eigh", lambda m: _real(_rebuilt_eigh(m), 6), _GRAM_SQL),
    ("cholesky", lambda m: _real(_rebuilt_cholesky(m), 6), _GRAM_SQL), ("lu", lambda m: _real(con.multi_dot(list(ker.lu(_mean_gram(m)))), 6), _GRAM_SQL),
    ("hessenberg", lambda m: _real(_rebuilt_hessenberg(m), 6), _GRAM_SQL),
    ("eig", lambda m: _moments(ker.eig(_mean_gram(m))[0]), _MOMENTS_SQL), ("schur", lambda m: _moments(shaping.diagonal(ker.schur(_mean_gram(m))[0])), _MOMENTS_SQL),
    ("inv", lambda m: _real(con.matmul(_mean_gram(m), ker.inv(_mean_gram(m))), 6), "SELECT i0, i1, (i0 = i1)::INT::DOUBLE AS v FROM g"),
    ("solve", lambda m: _real(con.matmul(_mean_gram(m), ker.solve(_mean_gram(m), m.transpose()))), "SELECT i1 AS i0, i0 AS i1, round(v, 5) + 0.0 AS v FROM m"),
    ("pinv", lambda m: _real(con.multi_dot([m, ker.pinv(m), m])), "SELECT i0, i1, round(v, 5) + 0.0 AS v FROM m"),
    ("lstsq", lambda m: _real(_fitted(m), 4), f"SELECT i0, round(v * {_N}, 4) + 0.0 AS v FROM g WHERE i1 = 63 AND i0 < 63"),
    ("det", lambda m: ker.det(_mean_gram(m)).map(lambda v: F.round(F.log(v), 6)).df, "SELECT round(sum(ln(v)), 6) AS v FROM p WHERE i = k AND j = k"),
    ("slogdet", lambda m: ker.slogdet(_mean_gram(m))[1].map(lambda v: F.round(v, 6)).df, "SELECT round(sum(ln(v)), 6) AS v FROM p WHERE i = k AND j = k"),
    ("matrix_power", lambda m: _real(con.matrix_power(_mean_gram(m), 3), 6), "SELECT a.i0, c.i1, round(sum(a.v * b.v * c.v), 6) + 0.0 AS v FROM g a JOIN g b ON a.i1 = b.i0 JOIN g c ON b.i1 = c.i0 GROUP BY 1, 2"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(_matrix(spark, sf_dir))
    ORACLES[_name] = f"WITH RECURSIVE {_G}{', ' + _PIVOTS if ' FROM p ' in _sql else ''} {_sql}"

QUERIES["permutation"] = lambda spark, sf_dir: rnd.permutation(_matrix(spark, sf_dir), 7).df

for _name, _f, _sql in (
    ("linspace", lambda s: shaping.linspace(s, 0.0, 1.0, 11), "SELECT range AS i0, round(range / 10.0, 9) AS v FROM range(11)"), ("logspace", lambda s: shaping.logspace(s, 0.0, 3.0, 4), "SELECT range AS i0, round(pow(10, range), 9) AS v FROM range(4)"), ("geomspace", lambda s: shaping.geomspace(s, 1.0, 256.0, 9), "SELECT range AS i0, round(pow(2, range), 9) AS v FROM range(9)"),
    ("arange", lambda s: shaping.arange(s, 1.0, 3.0, 0.25), "SELECT range AS i0, round(1 + range * 0.25, 9) AS v FROM range(8)"), ("eye", lambda s: shaping.eye(s, 4), "SELECT a.range AS i0, b.range AS i1, (a.range = b.range)::INT::DOUBLE AS v FROM range(4) a, range(4) b"), ("hanning", lambda s: shaping.hanning(s, 16), "SELECT range AS i0, round(0.5 - 0.5 * cos(2 * pi() * range / 15), 9) AS v FROM range(16)"),
    ("hamming", lambda s: shaping.hamming(s, 16), "SELECT range AS i0, round(0.54 - 0.46 * cos(2 * pi() * range / 15), 9) AS v FROM range(16)"), ("fftfreq", lambda s: shaping.fftfreq(s, 9, 0.5), "SELECT range AS i0, round(CASE WHEN range < 5 THEN range ELSE range - 9 END / 4.5, 9) AS v FROM range(9)"), ("rfftfreq", lambda s: shaping.rfftfreq(s, 9, 0.5), "SELECT range AS i0, round(range / 4.5, 9) AS v FROM range(5)"),
    ("mgrid", lambda s: shaping.mgrid(s, [(0.0, 3.0, 1.0), (0.0, 2.0, 0.5)]), "SELECT k AS i0, a.range AS i1, b.range AS i2, CASE k WHEN 0 THEN a.range ELSE b.range * 0.5 END::DOUBLE AS v FROM (VALUES (0::BIGINT), (1)) x(k), range(3) a, range(4) b"), ("zeros", lambda s: shaping.zeros(s, (2, 3)), "SELECT a.range AS i0, b.range AS i1, 0.0::DOUBLE AS v FROM range(2) a, range(3) b"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: (a := f(spark)).map(lambda v: F.round(v, 9)).df
    ORACLES[_name] = _sql
for _name, _f in (
    ("random_uniform", lambda s: rnd.uniform(s, (1000,), seed=1)), ("random_randint", lambda s: rnd.randint(s, (1000,), 0, 10, 2)), ("random_normal", lambda s: rnd.normal(s, (1000,), seed=3)), ("random_exponential", lambda s: rnd.exponential(s, (1000,), seed=4)), ("random_poisson", lambda s: rnd.poisson(s, (1000,), 3.0, 5)), ("random_binomial", lambda s: rnd.binomial(s, (1000,), 9, 0.3, 6)),
    ("random_multinomial", lambda s: rnd.multinomial(s, (100,), 9, [0.2, 0.3, 0.5], 7)), ("random_multivariate_normal", lambda s: rnd.multivariate_normal(s, (100,), [0, 1], [[2, 1], [1, 2]], 8)), ("random_choice", lambda s: rnd.choice(shaping.arange(s, 0.0, 50.0), 20, False, seed=9)),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(spark).df


@query("polyfit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 4) AS b FROM lineitem")
def polyfit(spark, sf_dir):
    a, b = poly.polyfit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1)
    return spark.createDataFrame([(round(a, 4), round(b, 4))], "a double, b double")


@query("roots", "SELECT vec_id, len(embedding)::INT - 1 AS n, len(embedding)::INT - 1 AS near FROM embeddings")
def roots(spark, sf_dir):
    """The roots of each row's polynomial, and how many of them bring it near 0, beside the sum of its terms' sizes."""
    found = ker.roots(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("c")), "c")

    def value(z):
        zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0.0).alias("size"))
        size = F.hypot(z["re"], z["im"])
        return F.aggregate("c", zero, lambda s, x: F.struct(
            (s["re"] * z["re"] - s["im"] * z["im"] + x).alias("re"), (s["re"] * z["im"] + s["im"] * z["re"]).alias("im"), (s["size"] * size + F.abs(x)).alias("size")
        ))

    near = F.filter(F.transform("roots", value), lambda p: F.hypot(p["re"], p["im"]) <= 1e-9 * p["size"])
    return found.select("vec_id", F.size("roots").alias("n"), F.size(near).alias("near"))


@query("irr", "SELECT vec_id, 0.0::DOUBLE AS npv FROM embeddings")
def irr(spark, sf_dir):
    """The present value of each row's flows at its rate of return: 0."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.array(F.lit(-10.0)), F.transform("embedding", lambda x: F.abs(x).cast("double"))).alias("c"))
    worth = F.aggregate(F.reverse("c"), F.lit(0.0), lambda s, x: s / (1 + F.col("irr")) + x)
    return ker.irr(e, "c").select("vec_id", (F.round(worth, 6) + 0.0).alias("npv"))


@query("tuner")
def tuned(spark, sf_dir):
    frames = spark.range(8).select(F.lit("a").alias("session"), F.col("id").alias("seq"), F.expr("transform(sequence(0, 4095), i -> sin(2 * pi() * 110.3 * i / 8192))").alias("samples"))
    return tuner.track(frames, 8192)


# files: what comes back from the shared folder, where the master sees it as a path
def _file(spark, name: str) -> str:
    folder = storage.shared_dir(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, f"{uuid.uuid4().hex}-{name}")


def _column_means(spark, sf_dir) -> SparkArray:
    return red.reduce(_matrix(spark, sf_dir), "mean", 0)


_MEANS = f"SELECT i1 AS i0, round(avg(v), 6) + 0.0 AS v FROM ({_M}) GROUP BY i1"


@query("npy", f"SELECT i0, i1, round(v, 6) + 0.0 AS v FROM ({_M})")
def npy(spark, sf_dir):
    path = _file(spark, "m.npy")
    files.save(path, _matrix(spark, sf_dir))
    return matrix_queries.rounded(files.load(spark, path), 6)


@query("npz", _MEANS)
def npz(spark, sf_dir):
    path = _file(spark, "m.npz")
    files.savez(path, {"means": _column_means(spark, sf_dir)}, compressed=True)
    return matrix_queries.rounded(files.loadz(spark, path)["means"], 6)


@query("safetensors", _MEANS)
def safetensors(spark, sf_dir):
    path = _file(spark, "m.safetensors")
    files.save_safetensors_file(path, {"means": _column_means(spark, sf_dir)})
    return matrix_queries.rounded(files.load_safetensors_file(spark, path)["means"], 6)


# solvers of functions, on the driver
def _bowl(x) -> float:
    return float((x[0] - 1) ** 2 + 2 * (x[1] + 2) ** 2)


def _bowl_slope(x) -> list[float]:
    return [2 * (x[0] - 1), 4 * (x[1] + 2)]


for _name, _f, _sql in (
    ("brentq", lambda: [optimize.brentq(lambda x: x**3 - 2, 0.0, 2.0)], "round(cbrt(2.0), 8)"),
    ("newton", lambda: [optimize.newton(lambda x: x**3 - 2, 1.0, lambda x: 3 * x * x)], "round(cbrt(2.0), 8)"),
    ("root_scalar", lambda: [optimize.root_scalar(lambda x: math.cos(x), "brentq", (1.0, 2.0))], "round(pi() / 2, 8)"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: spark.createDataFrame([tuple(round(float(x), 8) for x in f())], "v double")
    ORACLES[_name] = f"SELECT {_sql}::DOUBLE AS v"
for _name, _f in (
    ("nelder_mead", lambda: optimize.nelder_mead(_bowl, [0.0, 0.0], 1e-8, 1e-12)), ("lbfgs", lambda: optimize.lbfgs(_bowl, [0.0, 0.0], _bowl_slope)),
    ("minimize", lambda: optimize.minimize(_bowl, [0.0, 0.0], "lbfgs", _bowl_slope)),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: spark.createDataFrame([tuple(round(float(x), 3) for x in f()[0])], "x double, y double")
    ORACLES[_name] = "SELECT 1.0::DOUBLE AS x, -2.0::DOUBLE AS y"


matrix_queries.register(QUERIES, ORACLES, _matrix, _M)
