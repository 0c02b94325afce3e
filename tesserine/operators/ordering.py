"""Sorting, searching, selection and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ufuncs
from ..plans.array import SparkArray, sum_all
from ..plans.shapes import axis_of
from ..plans.storage import written
from .scans import positions, scan


def global_rank(df: DataFrame, keys: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with its place, from 0, in the order of ``keys``.

    A range partitioning sorts the rows over all tasks; a task's place is the
    number of rows before it, so no single task sees them all. The sorted rows
    are written, as both passes must see one partitioning, whose bounds are
    sampled, also after an executor is lost.
    """
    ordered = written(df.orderBy(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    local = F.col("__at") - F.shiftleft(F.col("__part").cast("bigint"), 33)
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = scan(sizes, "__n", "__upto", "sum", "__part").select("__part", (F.col("__upto") - F.col("__n")).alias("__before"))
    return ordered.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + local).drop("__part", "__at", "__before")  # a row a partition


def argsort(a: SparkArray, axis: int = -1) -> SparkArray:
    """The stable sorting permutation along an axis, NaN last."""
    return _sorted(a, axis, "at", "int64")


def sort(a: SparkArray, axis: int = -1) -> SparkArray:
    return _sorted(a, axis, "v", a.dtype)


def _sorted(a: SparkArray, axis: int, what: str, dtype: str) -> SparkArray:
    axis = axis_of(axis, a.rank)
    n = f"i{axis}"
    by = [c for c in a.index if c != n]
    if not by:
        ranked = global_rank(a.df.select("v", F.col(n).alias("at")), [F.col("v"), F.col("at")])
        return SparkArray(ranked.select(F.col("rank").alias("i0"), F.col(what).alias("v")), a.shape, dtype)
    w = Window.partitionBy(*by).orderBy("v", n)
    ranked = a.df.withColumn("at", F.col(n)).withColumn(n, (F.row_number().over(w) - 1).cast("bigint"))
    return SparkArray(ranked.select(*a.index, F.col(what).alias("v")), a.shape, dtype)


def partition(a: SparkArray, kth, axis: int = -1) -> SparkArray:
    """The kth cells in their sorted place; a full sort places them all."""
    n = a.shape[axis_of(axis, a.rank)]
    if any(not -n <= k < n for k in ([kth] if isinstance(kth, int) else kth)):
        raise ValueError("kth is beyond the axis")
    return sort(a, axis)


def argpartition(a: SparkArray, kth, axis: int = -1) -> SparkArray:
    partition(a, kth, axis)
    return argsort(a, axis)


def searchsorted(keys: DataFrame, queries: DataFrame, key: str = "v", query: str = "v", side: str = "left", out: str = "at") -> DataFrame:
    """``queries`` with the number of keys below each (left) or not above it (right).

    Keys and queries are sorted together in one pass and the keys are counted
    up to each query: no pair of them is compared.
    """
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    k = keys.select(F.col(key).cast("double").alias("__x"), F.lit(0 if side == "right" else 1).alias("__o"), F.lit(1).cast("bigint").alias("__k"), F.lit(None).cast("bigint").alias("__id"))
    tagged = written(queries.withColumn("__id", F.monotonically_increasing_id()))  # read twice: the ids must not differ
    q = tagged.select(F.col(query).cast("double").alias("__x"), F.lit(1 if side == "right" else 0).alias("__o"), F.lit(0).cast("bigint").alias("__k"), "__id")
    both = written(k.unionByName(q).orderBy("__x", "__o").withColumn("__part", F.spark_partition_id()))
    local = both.withColumn("__n", F.sum("__k").over(Window.partitionBy("__part").orderBy("__x", "__o").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = both.groupBy("__part").agg(F.sum("__k").alias("__c"))
    before = scan(sizes, "__c", "__upto", "sum", "__part").select("__part", (F.col("__upto") - F.col("__c")).alias("__before"))
    counted = local.where("__id is not null").join(F.broadcast(before), "__part")  # a row a partition
    return tagged.join(counted.select("__id", (F.col("__n") + F.col("__before")).alias(out)), "__id").drop("__id")


def in_edges(x: Column, edges: list[float], right: bool = False) -> Column:
    """digitize: the interval of x among monotone edges, decreasing ones too."""
    up = all(a <= b for a, b in zip(edges, edges[1:]))
    if not up and not all(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges are monotone")
    e = F.array(*(F.lit(float(v)) for v in (edges if up else reversed(edges))))
    strict = right if up else not right
    n = F.aggregate(e, F.lit(0), lambda a, v: a + F.when(v < x if strict else v <= x, 1).otherwise(0))
    return n if up else len(edges) - n


def where(condition: SparkArray, x=None, y=None):
    """Three arguments: a choice of cells; one: the coordinates of true cells, an array each axis."""
    if x is None:
        return nonzero(condition)
    a = condition.binary(x, lambda c, v: F.struct(c.alias("c"), v.alias("x")))
    dtype = next((o.dtype for o in (x, y) if isinstance(o, SparkArray)), "float64")
    return a.binary(y, lambda s, v: F.when(s["c"], s["x"]).otherwise(v), dtype)


def argwhere(a: SparkArray) -> SparkArray:
    """Coordinates of the cells that aren't 0, a row each, in C order."""
    hits = a.df.where(F.col("v").cast("double") != 0).select(a.flat().alias("__at"), F.array(*(F.col(n) for n in a.index)).alias("__c"))
    ranked, n = positions(hits, "__at", a.size)
    cells = ranked.select(F.col("pos").alias("i0"), F.posexplode("__c").alias("i1", "v"))
    return SparkArray(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), "v"), (n, a.rank), "int64")


def nonzero(a: SparkArray) -> list[SparkArray]:
    both = argwhere(a)
    return [SparkArray(both.df.where(F.col("i1") == k).select("i0", "v"), (both.shape[0],), "int64") for k in range(a.rank)]


def flatnonzero(a: SparkArray) -> SparkArray:
    return nonzero(a.flatten())[0]


def extract(condition: SparkArray, a: SparkArray) -> SparkArray:
    return a.apply_mask(condition)


COMPARE = {"eq": ufuncs.equal, "ne": ufuncs.not_equal, "gt": ufuncs.greater, "ge": ufuncs.greater_equal, "lt": ufuncs.less, "le": ufuncs.less_equal}


def find_index(a: SparkArray, op: str, target, start: list[int] | None = None, directions: list[int] | None = None) -> tuple[int, ...] | None:
    """The first coordinates, from ``start`` in the ``directions``, whose cell compares so; a top-1, no sort."""
    start, directions = start or [0] * a.rank, directions or [1] * a.rank
    ahead = [F.col(n) >= s if d > 0 else F.col(n) <= s for n, s, d in zip(a.index, start, directions)]
    key = F.struct(*((F.col(n) * d).alias(n) for n, d in zip(a.index, directions)))
    best = a.df.where(COMPARE[op]("v", target) & sum_all(ahead)).agg(F.min(key).alias("k")).head()["k"]
    return None if best is None else tuple(best[n] * d for n, d in zip(a.index, directions))


# sets: distinct values in order, NaN one value and last
def unique(a: SparkArray) -> dict[str, SparkArray]:
    """values, first index, counts and inverse of the distinct cells."""
    flat = a.flatten().df
    groups = flat.groupBy("v").agg(F.min("i0").alias("first"), F.count("*").alias("n"))
    ranked = global_rank(groups, [F.col("v")])
    n = groups.count()
    out = {name: SparkArray(ranked.select(F.col("rank").alias("i0"), F.col(c).alias("v")), (n,), t) for name, c, t in (("values", "v", a.dtype), ("index", "first", "int64"), ("counts", "n", "int64"))}
    same = flat["v"].eqNullSafe(ranked["v"])
    out["inverse"] = SparkArray(flat.join(ranked, same).select(flat["i0"], F.col("rank").alias("v")), (a.size,), "int64")
    return out


def _ordered(df: DataFrame, dtype: str) -> SparkArray:
    return SparkArray(global_rank(df, [F.col("v")]).select(F.col("rank").alias("i0"), "v"), (df.count(),), dtype)


def intersect1d(a: SparkArray, b: SparkArray) -> SparkArray:
    return _ordered(a.df.select("v").intersect(b.df.select("v")), a.dtype)


def union1d(a: SparkArray, b: SparkArray) -> SparkArray:
    return _ordered(a.df.select("v").union(b.df.select("v")).distinct(), a.dtype)


def setdiff1d(a: SparkArray, b: SparkArray) -> SparkArray:
    return _ordered(a.df.select("v").subtract(b.df.select("v")), a.dtype)


def setxor1d(a: SparkArray, b: SparkArray) -> SparkArray:
    x = a.df.select("v", F.lit(1).alias("s")).distinct().union(b.df.select("v", F.lit(2).alias("s")).distinct())
    return _ordered(x.groupBy("v").agg(F.sum("s").alias("s")).where("s < 3").select("v"), a.dtype)


def isin(a: SparkArray, test: SparkArray, invert: bool = False) -> SparkArray:
    known = test.df.select(F.col("v").alias("w")).distinct().withColumn("hit", F.lit(True))
    both = a.df.join(known, F.col("v").eqNullSafe(F.col("w")), "left")
    flag = F.coalesce("hit", F.lit(False))
    return SparkArray(both.select(*a.index, (~flag if invert else flag).alias("v")), a.shape, "boolean")


# gather and scatter along an axis
def take_along_axis(a: SparkArray, indices: SparkArray, axis: int) -> SparkArray:
    axis = axis_of(axis, a.rank)
    n = f"i{axis}"
    shape = tuple(s if k == axis else d for k, (d, s) in enumerate(zip(a.shape, indices.shape)))
    want = indices.broadcast_to(shape).df.withColumn("__to", F.col(n)).withColumn(n, F.pmod("v", F.lit(a.shape[axis]))).drop("v")
    both = want.join(a.df, a.index)
    return SparkArray(both.select(*(F.col("__to").alias(c) if c == n else F.col(c) for c in a.index), "v"), shape, a.dtype)


def put_along_axis(a: SparkArray, indices: SparkArray, values, axis: int) -> SparkArray:
    """Cells set by index; of several for one cell, the last in the indices' order stays."""
    axis = axis_of(axis, a.rank)
    n = f"i{axis}"
    shape = tuple(s if k == axis else d for k, (d, s) in enumerate(zip(a.shape, indices.shape)))
    src = indices.broadcast_to(shape)
    cells = src.paired(values.broadcast_to(shape))[0] if isinstance(values, SparkArray) else src.df.withColumn("w", F.lit(values))
    new = cells.withColumn("__from", F.col(n)).withColumn(n, F.pmod("v", F.lit(a.shape[axis]))).groupBy(*a.index).agg(F.max_by("w", "__from").alias("__new"), F.lit(True).alias("__hit"))
    after = a.df.join(new, a.index, "left")
    return SparkArray(after.select(*a.index, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("v")).alias("v")), a.shape, a.dtype)


# binning
def bincount(x: DataFrame, value: str, weights: str | None = None, least: int = 0) -> DataFrame:
    """bin and v, the count or weight of each whole number from 0 up, without gaps; a negative number is an error."""
    checked = x.withColumn("__b", F.when(F.col(value) < 0, F.raise_error(F.lit("a negative number has no bin")).cast("bigint")).otherwise(F.col(value).cast("bigint")))
    total = F.sum(F.col(weights).cast("double")) if weights else F.count("*")
    got = checked.groupBy("__b").agg(total.alias("v"))
    top = got.agg(F.greatest(F.coalesce(F.max("__b") + 1, F.lit(0)), F.lit(least)).alias("n"))
    bins = top.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("bin"))
    zero = F.lit(0.0) if weights else F.lit(0)
    return bins.join(got, F.col("bin") == F.col("__b"), "left").select("bin", F.coalesce("v", zero).alias("v"))


def histogram(x: DataFrame, value: str, bins=10, range_: tuple[float, float] | None = None, density: bool = False, weights: str | None = None) -> DataFrame:
    """bin, left, right and v of equal or given bins; the last one is closed, what lies outside is dropped."""
    spark, v = x.sparkSession, F.col(value).cast("double")
    total = F.sum(F.col(weights).cast("double")) if weights else F.count("*")
    if isinstance(bins, int):
        if bins < 1:
            raise ValueError("one bin at least")
        if range_ is None:
            ends = x.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("a"), F.coalesce(F.max(v), F.lit(1.0)).alias("b"))
        else:
            ends = spark.range(1).select(F.lit(float(range_[0])).alias("a"), F.lit(float(range_[1])).alias("b"))
        flat = F.col("a") == F.col("b")
        ends = F.broadcast(ends.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi")))  # one row
        cells = x.select(v.alias("x"), *([weights] if weights else [])).crossJoin(ends).where("x >= lo and x <= hi")
        at = F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
        step = (F.col("hi") - F.col("lo")) / bins
        frame = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(ends).select("bin", (F.col("lo") + F.col("bin") * step).alias("left"), (F.col("lo") + (F.col("bin") + 1) * step).alias("right"))
    else:
        edges = [float(e) for e in bins]
        if any(a >= b for a, b in zip(edges, edges[1:])) or len(edges) < 2:
            raise ValueError("edges increase strictly")
        cells = x.select(v.alias("x"), *([weights] if weights else [])).where((F.col("x") >= edges[0]) & (F.col("x") <= edges[-1]))
        at = F.least(in_edges(F.col("x"), edges) - 1, F.lit(len(edges) - 2)).cast("int")
        frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, left double, right double")
    counted = cells.groupBy(at.alias("bin")).agg(total.alias("v"))
    full = frame.join(counted, "bin", "left").withColumn("v", F.coalesce("v", F.lit(0.0) if weights else F.lit(0)))
    if density:
        full = full.withColumn("v", F.col("v") / (F.sum("v").over(Window.partitionBy(F.lit(0))) * (F.col("right") - F.col("left"))))
    return full


def interp(queries: DataFrame, knots: DataFrame, x: str = "x", xp: str = "xp", fp: str = "fp", left: float | None = None, right: float | None = None, method: str = "linear", out: str = "v") -> DataFrame:
    """``queries`` with the value between the neighbouring knots, linear or of the nearest one (the left one of two).

    Knots and queries are sorted together once; each query sees the knot before
    and after it. Beyond the knots ``left`` and ``right``, else the end values.
    """
    tagged = written(queries.withColumn("__id", F.monotonically_increasing_id()))
    k = knots.select(F.col(xp).cast("double").alias("__x"), F.struct(F.col(xp).cast("double").alias("x"), F.col(fp).cast("double").alias("y")).alias("__k"), F.lit(None).cast("bigint").alias("__id"))
    q = tagged.select(F.col(x).cast("double").alias("__x"), F.lit(None).cast("struct<x:double,y:double>").alias("__k"), "__id")
    ends = F.broadcast(knots.agg(F.min_by(fp, xp).cast("double").alias("__first"), F.max_by(fp, xp).cast("double").alias("__last"), F.min(xp).cast("double").alias("__lo"), F.max(xp).cast("double").alias("__hi")))  # one row
    both = written(k.unionByName(q).orderBy("__x", F.col("__id").isNotNull()).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy("__x", F.col("__id").isNotNull())
    near = both.withColumn("__a", F.last("__k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first("__k", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    # a query at a partition's edge takes the knot from the next partition that has one
    edge = both.groupBy("__part").agg(F.max("__k").alias("__max"), F.min("__k").alias("__min"))
    e = Window.orderBy("__part")  # a row a partition
    edge = F.broadcast(edge.select("__part", F.last("__max", True).over(e.rowsBetween(Window.unboundedPreceding, -1)).alias("__pa"), F.first("__min", True).over(e.rowsBetween(1, Window.unboundedFollowing)).alias("__pb")))
    got = near.where("__id is not null").join(edge, "__part").crossJoin(ends).withColumn("__a", F.coalesce("__a", "__pa")).withColumn("__b", F.coalesce("__b", "__pb"))
    xa, ya, xb, yb, at = F.col("__a.x"), F.col("__a.y"), F.col("__b.x"), F.col("__b.y"), F.col("__x")
    inner = F.when(xa == at, ya).when(xb == at, yb)
    inner = inner.otherwise(ya + (yb - ya) * (at - xa) / (xb - xa)) if method == "linear" else inner.when(at - xa <= xb - at, ya).otherwise(yb)
    value = F.when(F.isnan(at), F.lit(float("nan"))).when(at < F.col("__lo"), F.col("__first") if left is None else F.lit(float(left))).when(at > F.col("__hi"), F.col("__last") if right is None else F.lit(float(right))).otherwise(inner)
    return tagged.join(got.select("__id", value.alias(out)), "__id").drop("__id")


