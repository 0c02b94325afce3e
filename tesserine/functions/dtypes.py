"""Element types, the Spark types that hold them, and how they promote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes and Spark type of each element type.
SPARK = {
    "float64": (8, "double"), "float32": (4, "float"), "float16": (2, "float"), "bfloat16": (2, "float"),
    "int64": (8, "bigint"), "int32": (4, "int"), "int16": (2, "smallint"), "int8": (1, "tinyint"),
    "uint64": (8, "decimal(20,0)"), "uint32": (4, "bigint"), "uint16": (2, "int"), "uint8": (1, "smallint"),
    "complex128": (16, "struct<re:double,im:double>"), "complex64": (8, "struct<re:float,im:float>"), "boolean": (1, "boolean"),
}

_FLOAT_BITS = {"float64": 53, "float32": 24, "float16": 11, "bfloat16": 8}


def kind(dtype: str) -> str:
    return {"c": "complex", "f": "float", "b": "float", "i": "int", "u": "uint"}[dtype[0]] if dtype != "boolean" else "bool"


def _holds_whole(width: int) -> str:
    return "float64" if width >= 8 else "float32"


def promote(a: str, b: str) -> str:
    """The type of a binary operation's result.

    Two booleans give uint8. A float absorbs the integers it was made for:
    float32 takes up to 16 bits, the half types up to 8, wider integers raise
    the result to the next float. Signed meets unsigned in the next wider
    signed type, uint64 in float64.
    """
    if a == b:
        return "uint8" if a == "boolean" else a
    if "boolean" in (a, b):
        return b if a == "boolean" else a
    kinds = {kind(a), kind(b)}
    if "complex" in kinds:
        other = {a, b} - {"complex64"}
        return "complex128" if other & {"complex128", "float64", "int64", "uint64"} else "complex64"
    if "float" in kinds:
        if kinds == {"float"}:
            return "float32" if {a, b} == {"float16", "bfloat16"} else max(a, b, key=_FLOAT_BITS.__getitem__)
        real, whole = (a, b) if kind(a) == "float" else (b, a)
        width = SPARK[whole][0]
        if real == "float64" or real == "float32" and width >= 4:
            return "float64"
        if real == "float32":
            return "float32"
        return real if width == 1 else "float32" if width < 8 else "float64"
    wa, wb = SPARK[a][0], SPARK[b][0]
    if len(kinds) == 1:
        return a if wa >= wb else b
    signed, unsigned = (wa, wb) if kind(a) == "int" else (wb, wa)
    if signed > unsigned:
        return f"int{8 * signed}"
    return "float64" if unsigned == 8 else f"int{16 * unsigned}"


def promote_device(a: str, b: str) -> str:
    """The device arrays' rule: booleans stay boolean and float32 absorbs every integer."""
    if a == b:
        return a
    if "float32" in (a, b) and {kind(a), kind(b)} <= {"float", "int", "uint"} and "float64" not in (a, b):
        return "float32"
    return promote(a, b)


def wrapped(c: Column, dtype: str) -> Column:
    """An exact integer value brought into the range of ``dtype``, modulo its width."""
    bits = 8 * SPARK[dtype][0]
    if bits == 64 and kind(dtype) == "int":
        d = c.cast("decimal(38,0)")
        m = F.pmod(d, F.lit(str(1 << 64)).cast("decimal(38,0)"))
        return F.when(m >= F.lit(str(1 << 63)).cast("decimal(38,0)"), m - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(m).cast("bigint")
    low = F.pmod(c, F.lit(1 << bits))
    if kind(dtype) == "int":
        low = F.when(low >= (1 << (bits - 1)), low - (1 << bits)).otherwise(low)
    return low.cast(SPARK[dtype][1])


def astype(c: Column, source: str, target: str) -> Column:
    """``c`` as ``target``; floats lose their fraction and wrap on their way to integers, half types are rounded."""
    if kind(target) == "complex":
        return c if kind(source) == "complex" else F.struct(c.cast("double").alias("re"), F.lit(0.0).alias("im")).cast(SPARK[target][1])
    if kind(source) == "complex":
        c, source = c["re"], "float64"
    if target == "boolean":
        return c if source == "boolean" else c != 0
    if source == "boolean":
        c = c.cast("int")
    if kind(target) in ("int", "uint"):
        if kind(source) == "float":
            c = F.when(F.isnan(c) | (F.abs(c) >= float(1 << 63)), F.lit(0)).otherwise(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))
        return wrapped(c, target)
    if target == "float16":
        return half(c.cast("double"), 10, -14, 65504.0)
    if target == "bfloat16":
        return half(c.cast("float").cast("double"), 7, -126, 3.3895313892515355e38)
    return c.cast(SPARK[target][1])


def half(c: Column, fraction: int, least: int, largest: float) -> Column:
    """Round to nearest, ties to even, with ``fraction`` bits after the leading one."""
    size = F.abs(c)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(least))
    step = F.pow(F.lit(2.0), exponent - fraction)
    rounded = F.rint(c / step) * step
    infinite = F.when(c < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.isnan(c) | (size == float("inf")) | (c == 0), c).when(F.abs(rounded) > largest, infinite).otherwise(rounded).cast("float")
