"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, written as materialize  # noqa: F401  (for the operators)

T = TypeVar("T")

#: One run of ASCII white space: what separates words.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch, and of what meets in one bucket; Spark's own bound.
BATCH, BUCKET = 8 << 20, 4 << 20
DEFAULT_BATCH = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, so that a batch of long texts fits a worker.

    Plans run after their operator has returned, so the bound stays for the
    session. It is the same for all operators, and one that the user has set is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH:
        spark.conf.set(name, str(BATCH))


def bucket_count(docs: DataFrame) -> int:
    """Buckets for what a table's texts meet in: they follow its bytes, so a bucket's size doesn't grow."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # a source without statistics
        size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(2 * parts(docs.sparkSession), size // BUCKET + 1)


def meet(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """own, blob and row, with each bucket's packs (own, blob) before its rows (own, row), for ``bucketwise``."""
    kind = rows.schema["row"].dataType
    told = packs.select("own", F.lit(0).alias("kind"), "blob", F.lit(None).cast(kind).alias("row"))
    whole = rows.select("own", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "row")
    return told.unionByName(whole).repartition("own").sortWithinPartitions("own", "kind").select("own", "blob", "row")


def bucketwise(batches: Iterator[pa.RecordBatch], opened: Callable[[list[bytes]], T]) -> Iterator[tuple[T, pa.StructArray]]:
    """What ``opened`` makes of a bucket's packs with each run of its rows; no more than a batch of rows is held."""
    last, packs, state = None, [], None
    for b in batches:
        own, told = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (told[1:] != told[:-1])
        cuts = [*np.flatnonzero(new).tolist(), len(own)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if own[lo] != last:
                last, packs, state = own[lo], [], None
            if told[lo]:
                packs += b.column(1)[lo:hi].to_pylist()
                continue
            if state is None:
                state, packs = opened(packs), []
            yield state, b.column(2)[lo:hi]


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc, text and the bucket that the document's results meet it in."""
    return docs.select(doc_key().alias("doc"), text_or_empty().alias("text")).withColumn("own", own_bucket("doc", buckets))


def own_bucket(doc: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def with_packs(docs: DataFrame, packs: DataFrame, buckets: int) -> DataFrame:
    """``meet`` for whole rows: each is a struct of doc, text and the caller's columns, whatever their names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select(own_bucket(doc_key(), buckets).alias("own"), F.struct(doc_key().alias("doc"), F.col("text").cast("string").alias("text"), whole).alias("row"))
    return meet(rows, packs)


def rebuilt(whole: pa.StructArray, texts: list[str | None], keep: list[bool] | None = None) -> pa.RecordBatch:
    """The caller's columns with ``texts`` in the place of text, and only the rows to keep."""
    names = [f.name for f in whole.type]
    columns = [pa.array(texts, f.type) if f.name == "text" else c for f, c in zip(whole.type, whole.flatten())]
    batch = pa.RecordBatch.from_arrays(columns, names)
    return batch if keep is None else batch.filter(pa.array(keep, pa.bool_()))


def frame(columns: list, schema: str) -> pa.RecordBatch:
    """Columns by the names of a schema such as "own int, blob binary"."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def rows_frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return frame(list(zip(*rows)) if rows else [[] for _ in schema.split(", ")], schema)


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
NO_ID = -(1 << 63)


def ids_back(docs: list[int]) -> pa.Array:
    """doc_id of each doc; the key that stands for a null is one again."""
    return pa.array([None if d == NO_ID else d for d in docs], pa.int64())
