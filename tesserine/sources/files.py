"""Readers and writers of array files.

``load`` reads an .npy file by ranges of rows: the header is read on the
driver, every task reads its own byte range with Hadoop's file system through
Spark's binary reader where the file is small, or by offset where the path is
local or mounted. ``save`` writes the cells in C order.
"""

from __future__ import annotations

import ast
import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.array import SparkArray, names
from ..plans.shapes import c_strides, size

#: Array descriptions of the format and element types here.
DESCR = {
    "<f8": "float64", "<f4": "float32", "<f2": "float16", "<i8": "int64", "<i4": "int32", "<i2": "int16", "|i1": "int8",
    "<u8": "uint64", "<u4": "uint32", "<u2": "uint16", "|u1": "uint8", "<c16": "complex128", "<c8": "complex64", "|b1": "boolean",
}
MAGIC = b"\x93NUMPY"
#: Type names of safetensors headers.
SAFE = {
    "F64": ("<f8", "float64"), "F32": ("<f4", "float32"), "F16": ("<f2", "float16"), "I64": ("<i8", "int64"), "I32": ("<i4", "int32"),
    "I16": ("<i2", "int16"), "I8": ("|i1", "int8"), "U64": ("<u8", "uint64"), "U32": ("<u4", "uint32"), "U16": ("<u2", "uint16"), "U8": ("|u1", "uint8"), "BOOL": ("|b1", "boolean"),
}
ROWS = 1 << 20


def npy_header(data: bytes) -> tuple[str, bool, tuple[int, ...], int]:
    """(description, Fortran order, shape, where the cells start)."""
    if data[:6] != MAGIC:
        raise ValueError("no npy file")
    wide = data[6] > 1
    n = struct.unpack("<I" if wide else "<H", data[8 : 12 if wide else 10])[0]
    start = 12 if wide else 10
    head = ast.literal_eval(data[start : start + n].decode("latin-1"))
    return head["descr"], head["fortran_order"], tuple(head["shape"]), start + n


def npy_bytes(a: np.ndarray) -> bytes:
    """A file of format 1.0 with its header padded to 64 bytes."""
    a = np.ascontiguousarray(a)
    head = f"{{'descr': '{a.dtype.str}', 'fortran_order': False, 'shape': {a.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin-1") + a.tobytes()


def _value(x, dtype: str):
    if dtype.startswith("complex"):
        return {"re": float(x.real), "im": float(x.imag)}
    return bool(x) if dtype == "boolean" else float(x) if dtype.startswith(("float", "bfloat")) else int(x)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class NpyReader(DataSourceReader):
    """Tasks of ``ROWS`` cells, each by its own byte range."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.descr, self.fortran, self.shape, self.start = npy_header(f.read(65536))
        self.path, self.dtype = path, DESCR[self.descr]

    def partitions(self):
        n = size(self.shape)
        return [_Range(k, min(k + ROWS, n)) for k in range(0, n, ROWS)] or [_Range(0, 0)]

    def read(self, part):
        kind = np.dtype(self.descr)
        with open(self.path, "rb") as f:
            f.seek(self.start + part.first * kind.itemsize)
            cells = np.frombuffer(f.read((part.last - part.first) * kind.itemsize), kind)
        steps = c_strides(tuple(reversed(self.shape)))[::-1] if self.fortran else c_strides(self.shape)
        for at, x in zip(range(part.first, part.last), cells):
            yield (*((at // s) % d for s, d in zip(steps, self.shape)), _value(x, self.dtype))


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        from ..functions.dtypes import SPARK

        r = NpyReader(self.options["path"])
        return "".join(f"{n} bigint, " for n in names(len(r.shape))) + f"v {SPARK[r.dtype][1]}"

    def reader(self, schema):
        return NpyReader(self.options["path"])


def load(spark: SparkSession, path: str) -> SparkArray:
    spark.dataSource.register(NpySource)
    r = NpyReader(path)
    return SparkArray(spark.read.format("npy").load(path), r.shape, r.dtype)


def ordered(a: SparkArray) -> np.ndarray:
    """The cells of one file, in order; a file is one task's, as the format has one body."""
    want = {v: k for k, v in DESCR.items()}[a.dtype if a.dtype != "bfloat16" else "float32"]
    return a.numpy().astype(want).reshape(a.shape)


def save(path: str, a: SparkArray) -> None:
    with open(path, "wb") as f:
        f.write(npy_bytes(ordered(a)))


def savez(path: str, arrays: dict[str, SparkArray], compressed: bool = False) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as z:
        for name, a in arrays.items():
            z.writestr(f"{name}.npy", npy_bytes(ordered(a)))


def members(spark: SparkSession, path: str) -> DataFrame:
    """member, shape, dtype and flat cells of an npz file or a folder of them, through Spark's binary reader."""

    def run(frames):
        for f in frames:
            rows = []
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        a = np.load(io.BytesIO(z.read(name)))
                        rows.append((name.removesuffix(".npy"), list(a.shape), DESCR[a.dtype.newbyteorder("<").str if a.dtype.itemsize > 1 else a.dtype.str], a.astype(float).ravel() if a.dtype.kind != "c" else np.abs(a).ravel()))
            yield pd.DataFrame(rows, columns=["member", "shape", "dtype", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, shape array<bigint>, dtype string, cells array<double>")


def loadz(spark: SparkSession, path: str) -> dict[str, SparkArray]:
    with zipfile.ZipFile(path) as z:
        found = {n: np.load(io.BytesIO(z.read(n))) for n in z.namelist()}
    return {n.removesuffix(".npy"): SparkArray.of(spark, a, DESCR[a.dtype.str]) for n, a in found.items()}


def safetensors_bytes(arrays: dict[str, SparkArray]) -> bytes:
    kinds = {t: (k, d) for k, (d, t) in SAFE.items()}
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        kind, descr = kinds[a.dtype]
        raw = a.numpy().astype(descr).tobytes()
        head[name] = {"dtype": kind, "shape": list(a.shape), "data_offsets": [at, at + len(raw)]}
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(body)


def load_safetensors(spark: SparkSession, data: bytes) -> dict[str, SparkArray]:
    (n,) = struct.unpack("<Q", data[:8])
    head = json.loads(data[8 : 8 + n])
    out = {}
    for name, t in head.items():
        if name == "__metadata__":
            continue
        descr, dtype = SAFE[t["dtype"]]
        lo, hi = t["data_offsets"]
        out[name] = SparkArray.of(spark, np.frombuffer(data[8 + n + lo : 8 + n + hi], descr).reshape(t["shape"]), dtype)
    return out


def save_safetensors_file(path: str, arrays: dict[str, SparkArray]) -> None:
    with open(path, "wb") as f:
        f.write(safetensors_bytes(arrays))


def load_safetensors_file(spark: SparkSession, path: str) -> dict[str, SparkArray]:
    with open(path, "rb") as f:
        return load_safetensors(spark, f.read())


def to_vector(df: DataFrame, key: str, value: str, rows: int) -> SparkArray:
    """A column ordered by a key from 0 to rows - 1."""
    return SparkArray(df.select(F.col(key).cast("bigint").alias("i0"), F.col(value).alias("v")), (rows,))
