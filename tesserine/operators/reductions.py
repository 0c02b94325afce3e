"""Reductions: over everything or along axes, always as a partial and a final aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ufuncs
from ..plans.array import SparkArray, names, small
from ..plans.shapes import axes_of, axis_of, c_strides

NAN = float("nan")


def _v(c: Column | str = "v") -> Column:
    return F.col(c) if isinstance(c, str) else c


def _kept(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def agg_sum(v="v") -> Column:
    return F.coalesce(F.sum(_v(v)), F.lit(0))


def agg_prod(v="v") -> Column:
    return F.coalesce(F.product(_v(v)), F.lit(1.0))


def agg_mean(v="v") -> Column:
    return F.coalesce(F.avg(_v(v)), F.lit(NAN))


def agg_variance(v="v", ddof: int = 0) -> Column:
    """From the population variance, whose update is stable; NaN where the count doesn't exceed ddof."""
    n = F.count(_v(v))
    return F.when(n > ddof, F.var_pop(_v(v)) * n / F.when(n > ddof, n - ddof)).otherwise(F.lit(NAN))


def agg_std(v="v", ddof: int = 0) -> Column:
    return F.sqrt(agg_variance(v, ddof))


def agg_min(v="v") -> Column:
    """NaN if any value is."""
    return F.when(F.max(F.isnan(_v(v).cast("double"))), F.lit(NAN)).otherwise(F.min(_v(v)))


def agg_max(v="v") -> Column:
    return F.max(_v(v))


def agg_ptp(v="v") -> Column:
    return agg_max(v) - agg_min(v)


def agg_all(v="v") -> Column:
    return F.coalesce(F.bool_and(_v(v).cast("double") != 0), F.lit(True))


def agg_any(v="v") -> Column:
    return F.coalesce(F.bool_or(_v(v).cast("double") != 0), F.lit(False))


def agg_count_nonzero(v="v") -> Column:
    return F.count_if(_v(v).cast("double") != 0)


def agg_nansum(v="v") -> Column:
    return F.coalesce(F.sum(_kept(_v(v))), F.lit(0.0))


def agg_nanmean(v="v") -> Column:
    return F.coalesce(F.avg(_kept(_v(v))), F.lit(NAN))


def agg_nanvar(v="v") -> Column:
    return F.coalesce(F.var_pop(_kept(_v(v))), F.lit(NAN))


def agg_nanstd(v="v") -> Column:
    return F.sqrt(agg_nanvar(v))


def agg_nanmin(v="v") -> Column:
    return F.min(_kept(_v(v)))


def agg_nanmax(v="v") -> Column:
    return F.max(_kept(_v(v)))


def agg_median(v="v") -> Column:
    return F.when(F.max(F.isnan(_v(v).cast("double"))), F.lit(NAN)).otherwise(F.percentile(_v(v), F.lit(0.5)))


def agg_average(v="v", w="w") -> Column:
    return ufuncs.divide(F.sum(_v(v) * _v(w)), F.sum(_v(w)))


def agg_argmax(pos="pos", v="v") -> Column:
    """First position of the largest value. NaN never wins, unless it comes first."""
    return _arg(pos, v, F.max, -1)


def agg_argmin(pos="pos", v="v") -> Column:
    return _arg(pos, v, F.min, 1)


def _arg(pos, v, best, sign) -> Column:
    p, x = _v(pos), _v(v).cast("double")
    key = F.struct(x.alias("x"), (sign * p).alias("p"))
    chosen = sign * best(F.when(~F.isnan(x), key))["p"]
    return F.when(F.max((p == 0) & F.isnan(x)), F.lit(0)).otherwise(F.coalesce(chosen, F.lit(0))).cast("bigint")


def agg_logaddexp(v="v", base: float = math.e) -> Column:
    """Of a group: by its largest value, so nothing overflows; two aggregates of one pass over sorted parts."""
    x = F.collect_list(_v(v).cast("double"))
    high = F.array_max(x)
    scale = math.log(base)
    total = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.exp((e - high) * scale))
    return F.when(F.abs(high) == float("inf"), high).otherwise(high + F.ln(total) / scale)


AGGREGATES: dict[str, Callable] = {
    "sum": agg_sum, "prod": agg_prod, "mean": agg_mean, "variance": agg_variance, "std": agg_std, "min": agg_min, "max": agg_max,
    "ptp": agg_ptp, "all": agg_all, "any": agg_any, "count_nonzero": agg_count_nonzero, "median": agg_median, "nansum": agg_nansum,
    "nanmean": agg_nanmean, "nanvar": agg_nanvar, "nanstd": agg_nanstd, "nanmin": agg_nanmin, "nanmax": agg_nanmax,
}

#: Reducible binary operators as aggregates.
REDUCERS: dict[str, Callable] = {
    "add": agg_sum, "multiply": agg_prod, "minimum": agg_min, "maximum": agg_max, "fmin": agg_nanmin, "fmax": agg_nanmax,
    "logaddexp": agg_logaddexp, "logaddexp2": lambda v="v": agg_logaddexp(v, 2.0),
    "bitwiseAnd": lambda v="v": F.bit_and(_v(v)), "bitwiseOr": lambda v="v": F.bit_or(_v(v)), "bitwiseXor": lambda v="v": F.bit_xor(_v(v)),
    "logicalAnd": agg_all, "logicalOr": agg_any, "logicalXor": lambda v="v": F.count_if(_v(v).cast("double") != 0) % 2 == 1,
    "gcd": lambda v="v": F.aggregate(F.array_distinct(F.collect_list(_v(v).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: ufuncs.gcd(a, x)),
    "lcm": lambda v="v": F.aggregate(F.array_distinct(F.collect_list(_v(v).cast("bigint"))), F.lit(1).cast("bigint"), lambda a, x: ufuncs.lcm(a, x)),
}


def reduced(a: SparkArray, aggregate: Column, axis=None, keepdims: bool = False, dtype: str = "float64") -> SparkArray:
    """Group by the axes that stay. Groups without cells (an axis of length 0) come from the shape."""
    gone = set(axes_of(axis, a.rank)) if a.rank else set()
    keep = [k for k in range(a.rank) if k not in gone]
    df = a.df.groupBy(*(f"i{k}" for k in keep)).agg(aggregate.alias("v")) if keep else a.df.agg(aggregate.alias("v"))
    if keepdims:
        cols = [F.lit(0).cast("bigint").alias(f"i{k}") if k in gone else F.col(f"i{k}") for k in range(a.rank)]
        return SparkArray(df.select(*cols, "v"), [1 if k in gone else d for k, d in enumerate(a.shape)], dtype)
    return SparkArray(df.select(*(F.col(f"i{k}").alias(n) for k, n in zip(keep, names(len(keep)))), "v"), [a.shape[k] for k in keep], dtype)


def reduce(a: SparkArray, how: str, axis=None, keepdims: bool = False, initial=None, **options) -> SparkArray:
    """By a name of AGGREGATES or a reducible operator of REDUCERS; of complex cells sum, mean, all, any and count_nonzero."""
    if a.dtype.startswith("complex"):
        return _reduce_complex(a, how, axis, keepdims)
    make = AGGREGATES.get(how) or REDUCERS.get(how)
    if make is None:
        raise ValueError(f"{how} doesn't reduce")
    dtype = "boolean" if how in ("all", "any", "logicalAnd", "logicalOr", "logicalXor") else "int64" if how == "count_nonzero" else a.dtype if how in ("sum", "min", "max", "add") else "float64"
    if how in ("nanmin", "nanmax", "min", "max") and a.size == 0:
        raise ValueError("an empty array has no extreme")
    got = reduced(a, make("v", **options), axis, keepdims, dtype)
    return got if initial is None else got.map(lambda v: ufuncs.BINARY[how](F.lit(initial), v))


def _reduce_complex(a: SparkArray, how: str, axis, keepdims: bool) -> SparkArray:
    if how in ("all", "any", "count_nonzero"):
        cells = a.map(lambda v: ((v["re"] != 0) | (v["im"] != 0)).cast("int"), "int64")
        return reduce(cells, how, axis, keepdims)
    parts = {"sum": F.sum, "add": F.sum, "mean": F.avg}.get(how)
    if parts is None:
        raise ValueError(f"{how} doesn't reduce complex cells")
    return reduced(a, ufuncs.complex(F.coalesce(parts("v.re"), F.lit(0.0)), F.coalesce(parts("v.im"), F.lit(0.0))), axis, keepdims, a.dtype)


def arg_reduce(a: SparkArray, how: str, axis: int | None = None, keepdims: bool = False) -> SparkArray:
    make = {"argmax": agg_argmax, "argmin": agg_argmin}[how]
    if axis is None:
        return reduced(a, make(a.flat()), None, keepdims, "int64")
    return reduced(a, make(f"i{axis_of(axis, a.rank)}"), axis, keepdims, "int64")


def average(a: SparkArray, weights: SparkArray | None = None, axis=None) -> tuple[SparkArray, SparkArray]:
    """The weighted mean and the sum of weights."""
    w = weights if weights is not None else a.map(lambda v: F.lit(1.0))
    if weights is not None and weights.rank == 1 and a.rank > 1 and isinstance(axis, int):
        axis = axis_of(axis, a.rank)
        w = SparkArray(weights.df.select(*(F.lit(0).cast("bigint").alias(n) if k != axis else F.col("i0").alias(n) for k, n in enumerate(a.index)), "v"), [d if k == axis else 1 for k, d in enumerate(a.shape)])
    both, _ = a.paired(w)
    cells = SparkArray(both.select(*a.index, "v", "w"), a.shape)
    return reduced(cells, agg_average(), axis), reduced(cells, F.sum("w"), axis)


def cov(m: SparkArray, rowvar: bool = True, bias: bool = False, ddof: int | None = None, fweights: SparkArray | None = None, aweights: SparkArray | None = None) -> SparkArray:
    """Covariances of the rows (columns if not rowvar).

    Without weights a product of the centred matrix with itself, else one join
    on the observation and one aggregate of sums.
    """
    m = m.reshape(1, -1) if m.rank == 1 else m if rowvar else m.transpose()
    k, n = m.shape
    ddof = (0 if bias else 1) if ddof is None else ddof
    if fweights is None and aweights is None and m.dtype == "float64":
        from .contractions import matmul

        centred = m - reduce(m, "mean", 1, True)
        return matmul(centred, centred.transpose()).map(lambda v: v / float(n - ddof) if n > ddof else F.lit(NAN))
    x = m.df.select(F.col("i0").alias("r"), F.col("i1").alias("o"), F.col("v").cast("double").alias("x"), F.lit(1.0).alias("f"), F.lit(1.0).alias("a"))
    for w, name in ((fweights, "f"), (aweights, "a")):
        if w is not None:
            x = x.drop(name).join(small(w.df.select(F.col("i0").alias("o"), F.col("v").cast("double").alias(name)), w.shape), "o")
    x = x.withColumn("w", F.col("f") * F.col("a"))
    means = x.groupBy("r").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"))
    c = x.join(small(means, (k,)), "r").select("r", "o", (F.col("x") - F.col("mean")).alias("d"), "w", (F.col("w") * F.col("a")).alias("wa"))
    pairs = c.alias("p").join(c.select(F.col("r").alias("s"), "o", F.col("d").alias("e")), "o").where("r <= s")
    v1 = F.sum("w")
    fact = v1 - ddof * F.sum("wa") / v1
    half = pairs.groupBy("r", "s").agg(F.when(fact > 0, F.sum(F.col("w") * F.col("d") * F.col("e")) / F.when(fact > 0, fact)).otherwise(F.lit(NAN)).alias("v"))
    full = half.union(half.where("r < s").select("s", "r", "v"))
    return SparkArray(full.select(F.col("r").alias("i0"), F.col("s").alias("i1"), "v"), (k, k))


def corrcoef(m: SparkArray, rowvar: bool = True, **weights) -> SparkArray:
    """Pearson's coefficients; NaN for a row without variance."""
    c = cov(m, rowvar, **weights)
    d = c.df.where("i0 = i1").select(F.col("i0").alias("k"), F.sqrt("v").alias("s"))
    out = c.df.join(small(d.select(F.col("k").alias("i0"), F.col("s").alias("a")), c.shape), "i0").join(small(d.select(F.col("k").alias("i1"), F.col("s").alias("b")), c.shape), "i1")
    r = ufuncs.divide("v", F.col("a") * F.col("b"))
    return SparkArray(out.select("i0", "i1", F.when(F.isnan(r), r).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("v")), c.shape)


#: Virtual index (from 0) of probability q in n values, and how its fraction is used.
QUANTILES: dict[str, tuple[Callable[[float, Column], Column], str]] = {
    "invertedCdf": (lambda q, n: q * n - 1, "up"),
    "averagedInvertedCdf": (lambda q, n: q * n - 1, "average"),
    "closestObservation": (lambda q, n: q * n - 1 - 0.5, "even"),
    "interpolatedInvertedCdf": (lambda q, n: q * n - 1, "linear"),
    "hazen": (lambda q, n: q * n - 0.5, "linear"),
    "weibull": (lambda q, n: q * (n + 1) - 1, "linear"),
    "linear": (lambda q, n: q * (n - 1), "linear"),
    "medianUnbiased": (lambda q, n: q * (n + 1 / 3) + 1 / 3 - 1, "linear"),
    "normalUnbiased": (lambda q, n: q * (n + 0.25) + 0.375 - 1, "linear"),
    "lower": (lambda q, n: q * (n - 1), "down"),
    "higher": (lambda q, n: q * (n - 1), "up"),
    "midpoint": (lambda q, n: q * (n - 1), "middle"),
    "nearest": (lambda q, n: q * (n - 1), "nearest"),
}


def quantile_columns(q: float, method: str, n: Column) -> tuple[Column, Column]:
    """(lower rank from 0, weight of the next value) of a quantile among n values."""
    index, how = QUANTILES[method]
    v = F.round(index(q, n.cast("double")), 9)
    j = F.floor(v)
    g = v - j
    one, zero = F.lit(1.0), F.lit(0.0)
    if how == "linear":
        w = g
    elif how == "up":
        w = F.when(g > 0, one).otherwise(zero)
    elif how == "down":
        w = zero
    elif how == "average":
        w = F.when(g > 0, one).otherwise(F.lit(0.5))
    elif how == "middle":
        w = F.when(g > 0, F.lit(0.5)).otherwise(zero)
    elif how == "nearest":
        w = F.when(g > 0.5, one).when((g == 0.5) & (j % 2 == 1), one).otherwise(zero)
    else:  # even: type 3, the even one of two equally near order statistics, counted from 1
        w = F.when(g > 0, one).when((j % 2) == 0, one).otherwise(zero)
    return j, w


def _leading(x: Column) -> Column:
    """A whole number that never falls as x rises: its sign, power of two and the next 12 bits; null for a null.

    Rounding may move the largest values below a power of two to the key before
    the next power's first, which keeps the order.
    """
    size = F.abs(x)
    power = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * 4096)
    key = F.when(size == float("inf"), F.lit(1 << 25)).otherwise((power + 1100) * 8192 + part)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * key).cast("bigint")


def quantile(df: DataFrame, value: str, q: float, method: str = "linear", by: tuple[str, ...] = ()) -> DataFrame:
    """by columns and v: a quantile of each group; NaN if the group holds one.

    Values are counted by their leading bits first, a few thousand counts for
    each power of two. Only the values that share their leading bits with one of
    the two ranks asked for are then counted one by one, so no task sorts a
    group. ``df`` is read twice.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    from pyspark.sql import Window

    cells = df.select(*by, F.col(value).cast("double").alias("__x"))
    cells = cells.withColumn("__bits", F.when(~F.isnan("__x"), _leading(F.col("__x"))))
    counted = cells.groupBy(*by, "__bits").agg(F.count("*").alias("__c"), F.max(F.isnan("__x")).alias("__nan"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = counted.withColumns({"__upto": F.sum("__c").over(w.orderBy("__bits")), "__n": F.sum("__c").over(w), "__bad": F.coalesce(F.max("__nan").over(w), F.lit(False))})
    j, share = quantile_columns(q, method, F.col("__n"))
    ends = ranked.select(
        *by, "__bits", (F.col("__upto") - F.col("__c")).alias("__base"), "__upto", "__bad", share.alias("__share"),
        F.least(F.greatest(j, F.lit(0)), F.col("__n") - 1).alias("__low"), F.least(F.greatest(j + 1, F.lit(0)), F.col("__n") - 1).alias("__high"),
    )
    holds = lambda r: (F.col("__upto") > F.col(r)) & (F.col("__base") <= F.col(r))
    told = ["__base", "__bad", "__share", "__low", "__high"]
    spots = ends.where(holds("__low") | holds("__high")).select(*(F.col(c).alias(f"__of_{c}") for c in (*by, "__bits")), *told)
    same = reduce_and([F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, "__bits")])
    near = cells.join(spots if by else F.broadcast(spots), same)  # without groups two rows at most
    single = near.groupBy(*by, "__bits", "__x").agg(F.count("*").alias("__c"), *(F.first(c).alias(c) for c in told))
    placed = single.withColumn("__upto", F.col("__base") + F.sum("__c").over(Window.partitionBy(*by, "__bits").orderBy("__x")))
    placed = placed.withColumn("__base", F.col("__upto") - F.col("__c"))
    at = lambda r: F.max(F.when(holds(r), F.col("__x")))
    out = placed.groupBy(*by).agg(at("__low").alias("__a"), at("__high").alias("__b"), F.first("__share").alias("__share"), F.first("__bad").alias("__bad"))
    between = F.when((F.col("__share") == 0) | (F.col("__a") == F.col("__b")), F.col("__a")).when(F.col("__share") == 1, F.col("__b")).otherwise(F.col("__a") * (1 - F.col("__share")) + F.col("__b") * F.col("__share"))
    return out.select(*by, F.when(F.col("__bad"), F.lit(NAN)).otherwise(between).alias("v"))


def reduce_and(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out &= t
    return out


def quantile_array(a: SparkArray, q: float, axis=None, method: str = "linear", keepdims: bool = False) -> SparkArray:
    gone = set(axes_of(axis, a.rank))
    if a.size == 0:
        raise ValueError("an empty array has no quantile")
    keep = [k for k in range(a.rank) if k not in gone]
    got = quantile(a.df, "v", q, method, tuple(f"i{k}" for k in keep))
    if keepdims:
        return SparkArray(got.select(*(F.lit(0).cast("bigint").alias(f"i{k}") if k in gone else F.col(f"i{k}") for k in range(a.rank)), "v"), [1 if k in gone else d for k, d in enumerate(a.shape)])
    return SparkArray(got.select(*(F.col(f"i{k}").alias(n) for k, n in zip(keep, names(len(keep)))), "v"), [a.shape[k] for k in keep])


def percentile_array(a: SparkArray, q: float, **options) -> SparkArray:
    return quantile_array(a, q / 100, **options)


def is_close(a: SparkArray, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> SparkArray:
    return a.binary(b, lambda x, y: ufuncs.is_close(x, y, rtol, atol, equal_nan), "boolean")


def all_close(a: SparkArray, b, **options) -> bool:
    return bool(reduce(is_close(a, b, **options), "all").df.head()["v"])


def at(a: SparkArray, indices: SparkArray, updates: SparkArray, op: str) -> SparkArray:
    """a[indices] op= updates along axis 0 of a vector, where repeated indices add up."""
    if op not in ("add", "subtract", "multiply", "divide", "minimum", "maximum"):
        raise ValueError(f"{op} doesn't scatter")
    both, _ = indices.paired(updates)
    fold = {"add": "add", "subtract": "add", "multiply": "multiply", "divide": "multiply"}.get(op, op)
    folded = both.groupBy(F.pmod("v", F.lit(a.shape[0])).alias("i0")).agg(REDUCERS[fold]("w").alias("u"))
    after = a.df.join(folded, "i0", "left")
    return SparkArray(after.select("i0", F.when(F.col("u").isNull(), F.col("v")).otherwise(ufuncs.BINARY[op]("v", "u")).alias("v")), a.shape, a.dtype)


def reduceat(a: SparkArray, starts: list[int], op: str) -> SparkArray:
    """A reduction of each segment of a vector; a start at or beyond the next takes its own cell only."""
    n = a.shape[0]
    ends = [*starts[1:], n]
    rows = [(k, s, max(e, s + 1)) for k, (s, e) in enumerate(zip(starts, ends))]
    if any(not 0 <= s < n for s in starts):
        raise ValueError("a segment starts outside the array")
    seg = a.spark.createDataFrame(rows, "k bigint, lo bigint, hi bigint")
    cells = a.df.join(F.broadcast(seg), (F.col("i0") >= F.col("lo")) & (F.col("i0") < F.col("hi")))  # the caller's list
    return SparkArray(cells.groupBy("k").agg(REDUCERS[op]("v").alias("v")).select(F.col("k").alias("i0"), "v"), (len(starts),), a.dtype)


def trace(a: SparkArray, k: int = 0) -> SparkArray:
    return SparkArray(a.df.where(F.col("i1") - F.col("i0") == k).agg(agg_sum().alias("v")), (), a.dtype)


def norm(a: SparkArray, order=None, axis=None) -> SparkArray:
    """Vector norms of any order along one axis, matrix norms 1, -1, inf, -inf, 'fro' over two, 2-norm of all cells by default."""
    size = F.abs(F.col("v").cast("double"))
    if order is None or order == "fro":
        return reduced(a, F.sqrt(agg_sum(size * size)), axis)
    on = axes_of(axis, a.rank)
    if len(on) == 1:
        how = {math.inf: F.max(size), -math.inf: F.min(size), 0: F.sum(F.when(size != 0, 1.0).otherwise(0.0))}.get(order)
        return reduced(a, how if how is not None else F.pow(F.sum(F.pow(size, F.lit(float(order)))), F.lit(1.0 / order)), axis)
    if abs(order) == 1 or abs(order) == math.inf:
        first, best = (on[0] if abs(order) == 1 else on[1]), (F.max if order > 0 else F.min)
        return reduced(reduced(a, F.sum(size), first), best("v"))
    from .kernels import singular_values

    s = singular_values(a)
    return reduced(s, {2: F.max("v"), -2: F.min("v"), "nuc": F.sum("v")}[order])


def strides(a: SparkArray):
    return c_strides(a.shape)
