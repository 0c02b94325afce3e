"""Random arrays that depend on seed and position only, however the rows are spread."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes
from ..plans.array import SparkArray, names
from ..plans.shapes import size
from .ordering import global_rank
from .shaping import grid


def philox4x32(counter: tuple[int, int, int, int], key: tuple[int, int], rounds: int = 10) -> tuple[int, int, int, int]:
    """A block of the counter-based generator of Salmon and others (2011)."""
    a, b, c, d = counter
    k0, k1 = key
    for _ in range(rounds):
        x, y = 0xD2511F53 * a, 0xCD9E8D57 * c
        a, b, c, d = y >> 32 ^ b ^ k0, y & 0xFFFFFFFF, x >> 32 ^ d ^ k1, x & 0xFFFFFFFF
        k0, k1 = k0 + 0x9E3779B9 & 0xFFFFFFFF, k1 + 0xBB67AE85 & 0xFFFFFFFF
    return a, b, c, d


def unit(seed: int, at: Column, draw: int = 0) -> Column:
    """A number in [0, 1) of 53 bits, from a hash of seed, position and draw."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), at, F.lit(draw)), 11) * 2.0**-53


def gauss(seed: int, at: Column, draw: int = 0) -> Column:
    """Box and Muller's transform of two draws."""
    return F.sqrt(-2 * F.ln(1 - unit(seed, at, 2 * draw))) * F.cos(2 * math.pi * unit(seed, at, 2 * draw + 1))


def _filled(spark: SparkSession, shape, make, dtype: str = "float64") -> SparkArray:
    base = grid(spark, shape)
    a = SparkArray(base.withColumn("v", F.lit(0.0)), shape)
    return SparkArray(base.select(*names(len(shape)), make(a.flat()).cast(dtypes.SPARK[dtype][1]).alias("v")), shape, dtype)


def uniform(spark, shape, low: float = 0.0, high: float = 1.0, seed: int = 0):
    return _filled(spark, shape, lambda at: low + (high - low) * unit(seed, at))


def rand(spark, shape, seed: int = 0):
    return uniform(spark, shape, seed=seed)


def randint(spark, shape, low: int, high: int, seed: int = 0):
    if high <= low:
        raise ValueError("an empty range")
    return _filled(spark, shape, lambda at: low + F.floor(unit(seed, at) * (high - low)), "int64")


def normal(spark, shape, loc: float = 0.0, scale: float = 1.0, seed: int = 0):
    return _filled(spark, shape, lambda at: loc + scale * gauss(seed, at))


def exponential(spark, shape, scale: float = 1.0, seed: int = 0):
    return _filled(spark, shape, lambda at: -scale * F.ln(1 - unit(seed, at)))


def _drawn(spark, shape, seed: int, draw, width: int | None = None, dtype: str = "int64") -> SparkArray:
    """By numpy's generators, one for each block of 4096 positions, so a lost task draws the same again."""
    flat = spark.range(-(-size(shape) // 4096)).repartition(spark.sparkContext.defaultParallelism)
    n = size(shape)

    def run(frames):
        for f in frames:
            for b in f["id"]:
                r = np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, int(b)]))
                count = min(4096, n - int(b) * 4096)
                v = draw(r, count)
                yield pd.DataFrame({"at": np.arange(count) + int(b) * 4096, "v": list(v) if width else v})

    kind = dtypes.SPARK[dtype][1]
    got = flat.mapInPandas(run, f"at bigint, v {f'array<{kind}>' if width else kind}")
    if width:
        got = got.select("at", F.posexplode("v").alias("__k", "v"))
    full = (*shape, width) if width else tuple(shape)
    left, cols = n, []
    for k, d in enumerate(shape):
        left //= max(d, 1)
        cols.append((F.floor(F.col("at") / left) % d).cast("bigint").alias(f"i{k}"))
    if width:
        cols.append(F.col("__k").cast("bigint").alias(f"i{len(shape)}"))
    return SparkArray(got.select(*cols, "v"), full, dtype)


def poisson(spark, shape, lam: float = 1.0, seed: int = 0):
    return _drawn(spark, shape, seed, lambda r, n: r.poisson(lam, n))


def binomial(spark, shape, n: int, p: float, seed: int = 0):
    return _drawn(spark, shape, seed, lambda r, k: r.binomial(n, p, k))


def multinomial(spark, shape, n: int, p, seed: int = 0):
    p = np.asarray(p, float)
    return _drawn(spark, shape, seed, lambda r, k: r.multinomial(n, p / p.sum(), k), len(p))


def multivariate_normal(spark, shape, mean, cov, seed: int = 0):
    mean, low = np.asarray(mean, float), np.linalg.cholesky(np.asarray(cov, float))
    return _drawn(spark, shape, seed, lambda r, k: mean + r.standard_normal((k, len(mean))) @ low.T, len(mean), "float64")


def permutation(a: SparkArray, seed: int = 0) -> SparkArray:
    """Axis 0 in random order: a distributed sort by hash."""
    order = global_rank(a.spark.range(a.shape[0]).select(F.col("id").alias("i0")), [F.xxhash64(F.lit(seed), "i0"), F.col("i0")])
    both = a.df.join(order, "i0")
    return SparkArray(both.select(F.col("rank").alias("i0"), *a.index[1:], "v"), a.shape, a.dtype)


shuffle = permutation


def choice(a: SparkArray, n: int, replace: bool = True, p: SparkArray | None = None, seed: int = 0) -> SparkArray:
    """A sample of a vector, with or without replacement, by weights or evenly."""
    count = a.shape[0]
    if replace and p is None:
        at = a.spark.range(n).select(F.col("id").alias("to"), F.floor(unit(seed, F.col("id")) * count).alias("i0"))
        return SparkArray(at.join(a.df, "i0").select(F.col("to").alias("i0"), "v"), (n,), a.dtype)
    if not replace:
        if n > count:
            raise ValueError("a sample without replacement is no larger than its source")
        weighted = a.paired(p)[0].where("w > 0") if p is not None else a.df.withColumn("w", F.lit(1.0))
        key = -F.ln(1 - unit(seed, F.col("i0"))) / F.col("w")
        best = global_rank(weighted.withColumn("__key", key).orderBy("__key").limit(n), [F.col("__key")])
        return SparkArray(best.select(F.col("rank").alias("i0"), "v"), (n,), a.dtype)
    from .ordering import searchsorted
    from .scans import scan

    total = p.df.agg(F.sum("v").alias("s")).head()["s"]
    edges = scan(p.df, "v", "edge", "sum", "i0", (), count).select((F.col("edge") / total).alias("e"))
    draws = a.spark.range(n).select(F.col("id").alias("to"), unit(seed, F.col("id")).alias("u"))
    spots = searchsorted(edges, draws, "e", "u", "right").select("to", F.least("at", F.lit(count - 1)).alias("i0"))
    return SparkArray(spots.join(a.df, "i0").select(F.col("to").alias("i0"), "v"), (n,), a.dtype)
