"""Element-wise operators as Column expressions.

Every function takes columns or numbers and stays inside whole-stage codegen.
NaN and infinities follow IEEE 754 where Spark's SQL functions return null or
raise; null means "no value" and passes through. ``where`` keeps ``out`` (null
without it) where the mask is false.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def masked(value: Column, where=None, out=None) -> Column:
    return value if where is None else F.when(col(where), value).otherwise(F.lit(None) if out is None else col(out))


def _unary(f: Callable[[Column], Column]):
    def run(a, *, where=None, out=None) -> Column:
        return masked(f(col(a)), where, out)

    return run


def _binary(f: Callable[[Column, Column], Column]):
    def run(a, b, *, where=None, out=None) -> Column:
        return masked(f(col(a), col(b)), where, out)

    return run


def _nan(c: Column) -> Column:
    return F.isnan(c.cast("double"))


def _divided(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


def _floored(x: Column) -> Column:
    """floor as double; Spark's own gives a bigint, which infinities and large values don't fit."""
    x = x.cast("double")
    return F.when(_nan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(F.when(F.abs(x) < 2.0**52, x)).cast("double"))


def _ceiled(x: Column) -> Column:
    return -_floored(-x.cast("double"))


def _logged(f: Callable[[Column], Column], edge: float = 0.0):
    def run(x: Column) -> Column:
        x = x.cast("double")
        return F.when(_nan(x), x).when(x > edge, f(x)).when(x == edge, F.lit(-INF)).when(x < edge, F.lit(NAN))

    return run


def _log_sum(a: Column, b: Column, exp: Callable, log1p: Callable) -> Column:
    a, b = a.cast("double"), b.cast("double")
    high = F.greatest(a, b)
    return F.when(_nan(a) | _nan(b), F.lit(NAN)).when(F.abs(high) == INF, high).otherwise(high + log1p(exp(-F.abs(a - b))))


def _signed_zero(b: Column) -> Column:
    b = b.cast("double")
    return (b < 0) | ((b == 0) & (F.pow(b, F.lit(-1.0)) == -INF))


# arithmetic
add = _binary(lambda a, b: a + b)
subtract = _binary(lambda a, b: a - b)
multiply = _binary(lambda a, b: a * b)
divide = _binary(_divided)
positive = _unary(lambda a: a)
negative = _unary(lambda a: -a)
square = _unary(lambda a: a * a)
sqrt = _unary(lambda a: F.sqrt(a.cast("double")))
cbrt = _unary(lambda a: F.cbrt(a.cast("double")))
reciprocal = _unary(lambda a: _divided(F.lit(1.0), a))
abs = _unary(F.abs)
sign = _unary(lambda a: F.signum(a.cast("double")))
ceil = _unary(_ceiled)
floor = _unary(_floored)
rint = _unary(lambda a: F.rint(a.cast("double")))
round = _unary(lambda a: F.when(_nan(a) | (F.abs(a) == INF), a).otherwise(F.round(F.when(F.abs(a) < INF, a.cast("double")))))
trunc = _unary(lambda a: F.when(a < 0, _ceiled(a)).otherwise(_floored(a)))
fix = trunc
power = _binary(lambda a, b: F.pow(a.cast("double"), b.cast("double")))
float_power = power
expm1 = _unary(lambda a: F.expm1(a.cast("double")))
log1p = _unary(_logged(F.log1p, -1.0))
logaddexp = _binary(lambda a, b: _log_sum(a, b, F.exp, F.log1p))
logaddexp2 = _binary(lambda a, b: _log_sum(a, b, lambda x: F.pow(F.lit(2.0), x), lambda x: F.log1p(x) / math.log(2)))
heaviside = _binary(lambda a, b: F.when(_nan(a), a.cast("double")).when(a < 0, F.lit(0.0)).when(a == 0, b.cast("double")).otherwise(F.lit(1.0)))
maximum = _binary(lambda a, b: F.when(_nan(a) | _nan(b), F.lit(NAN)).otherwise(F.greatest(a, b)))
minimum = _binary(lambda a, b: F.when(_nan(a) | _nan(b), F.lit(NAN)).otherwise(F.least(a, b)))
fmax = _binary(lambda a, b: F.when(_nan(a), b).when(_nan(b), a).otherwise(F.greatest(a, b)))
fmin = _binary(lambda a, b: F.when(_nan(a), b).when(_nan(b), a).otherwise(F.least(a, b)))


def int_power(a, b, *, where=None, out=None) -> Column:
    """Integer power; a negative exponent is an error."""
    a, b = col(a), col(b)
    ok = F.when(b >= 0, F.pow(a.cast("double"), b)).otherwise(F.raise_error(F.lit("negative exponent of an integer")).cast("double"))
    return masked(ok.cast("bigint"), where, out)


def _whole(a: Column, b: Column, of: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("integer division by zero")).cast("bigint")).otherwise(of)


def floor_divide(a, b, *, whole: bool = False, where=None, out=None) -> Column:
    """Floor of the quotient. Integers (``whole``) raise on 0, floats give NaN."""
    a, b = col(a), col(b)
    if whole:
        d = F.when(b != 0, b)
        rest = a % d  # the quotient is cut toward zero: less one where signs differ and a rest is left
        q = F.call_function("div", a, d)
        value = _whole(a, b, q - F.when((rest != 0) & ((rest < 0) != (d < 0)), 1).otherwise(0))
    else:
        value = F.when(b == 0, F.lit(NAN)).otherwise(_floored(_divided(a, b)))
    return masked(value, where, out)


def remainder(a, b, *, whole: bool = False, where=None, out=None) -> Column:
    """The rest with the divisor's sign."""
    a, b = col(a), col(b)
    d = F.when(b != 0, b)
    rest = a % d
    signed = F.when((rest != 0) & ((rest < 0) != (d < 0)), rest + d).otherwise(rest)
    return masked(_whole(a, b, signed) if whole else F.when(b == 0, F.lit(NAN)).otherwise(signed), where, out)


mod = remainder


def divmod(a, b, *, whole: bool = False) -> Column:
    return F.struct(floor_divide(a, b, whole=whole).alias("q"), remainder(a, b, whole=whole).alias("r"))


def fmod(a, b, *, whole: bool = False, where=None, out=None) -> Column:
    """The rest with the dividend's sign."""
    a, b = col(a), col(b)
    rest = a % F.when(b != 0, b)
    return masked(_whole(a, b, rest) if whole else F.when(b == 0, F.lit(NAN)).otherwise(rest), where, out)


def gcd(a, b, *, where=None, out=None) -> Column:
    """Greatest common divisor by Euclid's steps, 93 of which end for any two 64-bit numbers.

    The steps run on the negative side, which holds the magnitude of every number.
    """
    a, b = (F.when(col(x) > 0, -col(x)).otherwise(col(x)).cast("bigint") for x in (a, b))
    pair = F.struct(a.alias("x"), b.alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] != 0, s["y"])).alias("y")))
    return masked(F.aggregate(F.sequence(F.lit(1), F.lit(93)), pair, step, lambda s: -s["x"]), where, out)


def lcm(a, b, *, where=None, out=None) -> Column:
    a, b = col(a), col(b)
    g = gcd(a, b)
    return masked(F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a, F.when(g != 0, g)) * b)), where, out)


def wrapping(op: str, a, b, *, where=None, out=None) -> Column:
    """64-bit integer add, subtract or multiply that wraps on overflow."""
    from .dtypes import wrapped

    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    tried, sure = {
        "add": (F.try_add, lambda x, y: x + y), "subtract": (F.try_subtract, lambda x, y: x - y), "multiply": (F.try_multiply, None),
    }[op]
    if sure:
        wide = wrapped(sure(a.cast("decimal(20,0)"), b.cast("decimal(20,0)")), "int64")
    else:  # by 32-bit halves, as the product of two 64-bit numbers has more digits than a decimal
        low = F.lit((1 << 32) - 1)
        al, bl = a.bitwiseAND(low), b.bitwiseAND(low)
        ah, bh = F.shiftrightunsigned(a, 32), F.shiftrightunsigned(b, 32)
        dec = lambda x: x.cast("decimal(19,0)")
        cross = wrapped(dec(al) * dec(bh) + dec(ah) * dec(bl), "int64").bitwiseAND(low)
        wide = wrapped(dec(al) * dec(bl) + (dec(cross) * F.lit(1 << 32).cast("decimal(18,0)")), "int64")
    return masked(F.coalesce(tried(a, b), wide), where, out)


# exponential and logarithmic
exp = _unary(lambda a: F.exp(a.cast("double")))
log = _unary(_logged(F.ln))
log2 = _unary(_logged(F.log2))
log10 = _unary(_logged(F.log10))

# trigonometric
sin, cos, tan = (_unary(lambda a, f=f: f(a.cast("double"))) for f in (F.sin, F.cos, F.tan))
asin, acos, atan = (_unary(lambda a, f=f: f(a.cast("double"))) for f in (F.asin, F.acos, F.atan))
sinh, cosh, tanh = (_unary(lambda a, f=f: f(a.cast("double"))) for f in (F.sinh, F.cosh, F.tanh))
asinh, acosh, atanh = (_unary(lambda a, f=f: f(a.cast("double"))) for f in (F.asinh, F.acosh, F.atanh))
sinc = _unary(lambda a: F.when(a == 0, F.lit(1.0)).otherwise(_divided(F.sin(math.pi * a), math.pi * a)))
csc, sec, cot = (_unary(lambda a, f=f: _divided(F.lit(1.0), f(a.cast("double")))) for f in (F.sin, F.cos, F.tan))
atan2 = _binary(lambda a, b: F.atan2(a.cast("double"), b.cast("double")))
hypot = _binary(lambda a, b: F.hypot(a.cast("double"), b.cast("double")))
deg2rad = _unary(lambda a: F.radians(a.cast("double")))
rad2deg = _unary(lambda a: F.degrees(a.cast("double")))

# floating point
isnan = _unary(_nan)
isinf = _unary(lambda a: F.abs(a.cast("double")) == INF)
isfinite = _unary(lambda a: ~_nan(a) & (F.abs(a.cast("double")) < INF))
copysign = _binary(lambda a, b: F.when(_signed_zero(b), -F.abs(a)).otherwise(F.abs(a)))


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False, *, where=None, out=None) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    near = F.when(_nan(a) | _nan(b), _nan(a) & _nan(b) & F.lit(equal_nan)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b)
    return masked(near.otherwise(F.abs(a - b) <= atol + rtol * F.abs(b)), where, out)


def nan_to_num(a, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None, *, where=None, out=None) -> Column:
    a = col(a).cast("double")
    big = 1.7976931348623157e308
    value = F.when(_nan(a), F.lit(nan)).when(a == INF, F.lit(big if posinf is None else posinf)).when(a == -INF, F.lit(-big if neginf is None else neginf))
    return masked(value.otherwise(a), where, out)


# comparison: NaN equals nothing and is never greater or less
def _compared(f):
    return _binary(lambda a, b: f(a, b) & ~_nan(a) & ~_nan(b))


equal = _compared(lambda a, b: a == b)
not_equal = _binary(lambda a, b: ~((a == b) & ~_nan(a) & ~_nan(b)))
greater = _compared(lambda a, b: a > b)
greater_equal = _compared(lambda a, b: a >= b)
less = _compared(lambda a, b: a < b)
less_equal = _compared(lambda a, b: a <= b)

# logical: 0 is false, all else, NaN too, is true
logical_not = _unary(lambda a: a == 0)
logical_and = _binary(lambda a, b: (a != 0) & (b != 0))
logical_or = _binary(lambda a, b: (a != 0) | (b != 0))
logical_xor = _binary(lambda a, b: (a != 0) != (b != 0))

# bitwise
bitwise_and = _binary(lambda a, b: a.bitwiseAND(b))
bitwise_or = _binary(lambda a, b: a.bitwiseOR(b))
bitwise_xor = _binary(lambda a, b: a.bitwiseXOR(b))
invert = _unary(F.bitwise_not)


def left_shift(a, b, width: int = 64, *, where=None, out=None) -> Column:
    a, b = col(a), col(b)
    return masked(F.when(b >= width, F.lit(0)).otherwise(F.call_function("shiftleft", a, b.cast("int"))), where, out)


def right_shift(a, b, width: int = 64, signed: bool = True, *, where=None, out=None) -> Column:
    a, b = col(a), col(b)
    name = "shiftright" if signed else "shiftrightunsigned"
    far = F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)) if signed else F.lit(0)
    return masked(F.when(b >= width, far).otherwise(F.call_function(name, a, b.cast("int"))), where, out)


def clip(a, low=None, high=None, *, where=None, out=None) -> Column:
    """Within the bounds, numbers or columns; NaN stays."""
    if isinstance(low, (int, float)) and isinstance(high, (int, float)) and low > high:
        raise ValueError("the lower bound is above the upper")
    a = value = col(a)
    if low is not None:
        value = F.greatest(value, col(low))
    if high is not None:
        value = F.least(value, col(high))
    return masked(F.when(_nan(a), a).otherwise(value), where, out)


clip_array = clip


# special functions
def i0(a, *, where=None, out=None) -> Column:
    """Modified Bessel function of order 0: its power series where that is short, the asymptotic series beyond."""
    x = F.abs(col(a).cast("double"))
    q = x * x / 4
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda s, k: F.struct((s["t"] * q / (k * k)).alias("t"), (s["s"] + s["t"] * q / (k * k)).alias("s")), lambda s: s["s"],
    )
    z = F.when(x > 0, x).otherwise(F.lit(1.0))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(16)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda s, k: F.struct((s["t"] * (2 * k - 1) * (2 * k - 1) / (8 * k * z)).alias("t"), (s["s"] + s["t"] * (2 * k - 1) * (2 * k - 1) / (8 * k * z)).alias("s")),
        lambda s: s["s"],
    )
    return masked(F.when(x <= 25, series).otherwise(F.exp(x) / F.sqrt(2 * math.pi * z) * tail), where, out)


#: Lanczos coefficients for g = 7, nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(a, *, where=None, out=None) -> Column:
    """The gamma function; NaN at 0 and the negative integers."""
    x = col(a).cast("double")

    def right(z: Column) -> Column:
        z = z - 1
        total = fold(lambda s, k: s + LANCZOS[k] / (z + k), range(1, 9), F.lit(LANCZOS[0]))
        t = z + 7.5
        return math.sqrt(2 * math.pi) * F.pow(t, (z + 0.5) / 2) * F.exp(-t) * F.pow(t, (z + 0.5) / 2) * total

    pole = (x <= 0) & (x == _floored(x))
    mirrored = _divided(F.lit(math.pi), F.sin(math.pi * x) * right(1 - x))
    return masked(F.when(pole | _nan(x), F.lit(NAN)).when(x < 0.5, mirrored).when(x > 171.7, F.lit(INF)).otherwise(right(F.least(x, F.lit(171.7)))), where, out)


def erf(a, *, where=None, out=None) -> Column:
    """The error function: its power series up to 3, a continued fraction for the rest."""
    x = col(a).cast("double")
    z = F.abs(x)
    q = z * z
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")),
        lambda s, k: F.struct((s["t"] * -q / k).alias("t"), (s["s"] + s["t"] * -q / k / (2 * k + 1)).alias("s")), lambda s: s["s"],
    )
    w = F.greatest(z, F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: (k / 2.0) / (w + f))
    value = F.when(z < 3, 2 / math.sqrt(math.pi) * series).otherwise(1 - F.exp(-q) / math.sqrt(math.pi) / (w + fraction))
    return masked(F.when(_nan(x), x).otherwise(F.signum(x) * value), where, out)


def erfc(a, *, where=None, out=None) -> Column:
    return masked(1 - erf(a), where, out)


def lambertw(a, *, where=None, out=None) -> Column:
    """The principal branch of w exp(w) = x by Halley's steps; NaN below -1/e."""
    x = col(a).cast("double")
    near = F.sqrt(F.greatest(2 * (math.e * x + 1), F.lit(0.0)))
    start = F.when(x < 0, -1 + near - near * near / 3).when(x < 3, F.log1p(F.greatest(x, F.lit(0.0))) * 0.8).otherwise(F.ln(F.greatest(x, F.lit(1.1))) - F.ln(F.ln(F.greatest(x, F.lit(3.0)))))

    def step(w: Column, _: Column) -> Column:
        f = w * F.exp(w) - x
        d = F.exp(w) * (w + 1) - (w + 2) * f / F.when(w == -1, F.lit(1.0)).otherwise(2 * w + 2)
        return F.when(d == 0, w).otherwise(w - f / F.when(d != 0, d))

    w = F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)
    return masked(F.when(_nan(x) | (x < -1 / math.e - 1e-15), F.lit(NAN)).when(x == INF, x).otherwise(w), where, out)


def zeta(a, *, where=None, out=None) -> Column:
    """Riemann's zeta function right of 1, by Euler and Maclaurin from the twelfth term; NaN left of it."""
    s, n = col(a).cast("double"), 12.0
    p = lambda k, e: F.pow(F.lit(float(k)), -e)
    head = fold(lambda t, k: t + p(k, s), range(2, 12), F.lit(1.0))
    tail = p(n, s - 1) / (s - 1) + p(n, s) / 2 + s * p(n, s + 1) / 12 - s * (s + 1) * (s + 2) * p(n, s + 3) / 720 + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * p(n, s + 5) / 30240
    return masked(F.when(s == 1, F.lit(INF)).when(s > 1, head + tail).otherwise(F.lit(NAN)), where, out)


def kronecker_delta(a, b, *, where=None, out=None) -> Column:
    return masked(F.when(col(a) == col(b), 1.0).otherwise(0.0), where, out)


def npv(rate, values, period) -> Column:
    """Net present value of a group: an aggregate over values at whole periods."""
    return F.sum(col(values).cast("double") / F.pow(1 + col(rate).cast("double"), col(period)))


# complex numbers: struct<re, im>
def complex(re, im=0.0) -> Column:
    return F.struct(col(re).cast("double").alias("re"), col(im).cast("double").alias("im"))


def real(z, *, where=None, out=None) -> Column:
    return masked(col(z)["re"], where, out)


def imag(z, *, where=None, out=None) -> Column:
    return masked(col(z)["im"], where, out)


def conj(z, *, where=None, out=None) -> Column:
    return masked(complex(col(z)["re"], -col(z)["im"]), where, out)


conjugate = conj


def angle(z) -> Column:
    return F.atan2(col(z)["im"], col(z)["re"])


def complex_abs(z) -> Column:
    return F.hypot(col(z)["re"], col(z)["im"])


def complex_add(x, y) -> Column:
    x, y = col(x), col(y)
    return complex(x["re"] + y["re"], x["im"] + y["im"])


def complex_subtract(x, y) -> Column:
    x, y = col(x), col(y)
    return complex(x["re"] - y["re"], x["im"] - y["im"])


def complex_multiply(x, y) -> Column:
    x, y = col(x), col(y)
    return complex(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def complex_divide(x, y) -> Column:
    x, y = col(x), col(y)
    d = y["re"] * y["re"] + y["im"] * y["im"]
    return complex(_divided(x["re"] * y["re"] + x["im"] * y["im"], d), _divided(x["im"] * y["re"] - x["re"] * y["im"], d))


def complex_exp(z) -> Column:
    z = col(z)
    return complex(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def complex_log(z) -> Column:
    return complex(log(complex_abs(z)), angle(z))


def complex_power(x, y) -> Column:
    return complex_exp(complex_multiply(y, complex_log(x)))


# selection
def choose(index, choices: list, mode: str = "raise") -> Column:
    """The choice that the index names; raise, wrap or clip beyond."""
    i, n = col(index), len(choices)
    if mode == "wrap":
        i = F.pmod(i, F.lit(n))
    elif mode == "clip":
        i = F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    elif mode == "raise":
        i = F.when((i >= 0) & (i < n), i).otherwise(F.raise_error(F.lit("choice out of range")).cast("int"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.element_at(F.array(*map(col, choices)), (i + 1).cast("int"))


def select(conditions: list, choices: list, default=0) -> Column:
    """The choice of the first true condition."""
    if not conditions or len(conditions) != len(choices):
        raise ValueError("as many choices as conditions, one at least")
    out = F
    for c, v in zip(conditions, choices):
        out = out.when(col(c), col(v))
    return out.otherwise(col(default))


def where(condition, x, y) -> Column:
    return F.when(col(condition), col(x)).otherwise(col(y))


# finance; ``when`` is 0 for payments at a period's end, 1 at its beginning
def fv(rate, nper, pmt, pv, when=0) -> Column:
    r, n, p, v, w = (col(x).cast("double") for x in (rate, nper, pmt, pv, when))
    t = F.pow(1 + r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v * t + p * (1 + r * w) / F.when(r != 0, r) * (t - 1)))


def pv(rate, nper, pmt, fv, when=0) -> Column:
    r, n, p, v, w = (col(x).cast("double") for x in (rate, nper, pmt, fv, when))
    t = F.pow(1 + r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v + p * (1 + r * w) / F.when(r != 0, r) * (t - 1)) / t)


# activations
relu = _unary(lambda a: F.when(a < 0, F.lit(0.0)).otherwise(a.cast("double")))
sigmoid = _unary(lambda a: 1 / (1 + F.exp(-a.cast("double"))))
silu = _unary(lambda a: a / (1 + F.exp(-a.cast("double"))))
gelu = _unary(lambda a: 0.5 * a * (1 + F.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a * a * a))))
softplus = _unary(lambda a: F.greatest(a, F.lit(0.0)) + F.log1p(F.exp(-F.abs(a.cast("double")))))
mish = _unary(lambda a: a * F.tanh(F.greatest(a, F.lit(0.0)) + F.log1p(F.exp(-F.abs(a.cast("double"))))))
hardswish = _unary(lambda a: a * F.least(F.greatest(a + 3, F.lit(0.0)), F.lit(6.0)) / 6)
rsqrt = _unary(lambda a: _divided(F.lit(1.0), F.sqrt(a.cast("double"))))

#: The binary operators by name, as used by outer, reduce, accumulate and at.
BINARY: dict[str, Callable] = {
    "add": add, "subtract": subtract, "multiply": multiply, "divide": divide, "floorDivide": floor_divide, "remainder": remainder,
    "fmod": fmod, "power": power, "floatPower": float_power, "minimum": minimum, "maximum": maximum, "fmin": fmin, "fmax": fmax,
    "logaddexp": logaddexp, "logaddexp2": logaddexp2, "arctan2": atan2, "hypot": hypot, "copysign": copysign, "gcd": gcd, "lcm": lcm,
    "bitwiseAnd": bitwise_and, "bitwiseOr": bitwise_or, "bitwiseXor": bitwise_xor, "leftShift": left_shift, "rightShift": right_shift,
    "heaviside": heaviside, "logicalAnd": logical_and, "logicalOr": logical_or, "logicalXor": logical_xor, "equal": equal,
    "notEqual": not_equal, "greater": greater, "greaterEqual": greater_equal, "less": less, "lessEqual": less_equal,
}
