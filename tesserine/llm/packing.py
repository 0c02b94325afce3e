"""Packing into windows by non-negative least squares over a length histogram.

A document's ids are cut into full windows and a remainder. The histogram of
the remainders has at most ``window - 1`` lengths, whatever the corpus, and is
all that the driver sees. Combinations of up to three lengths that fill the
window are columns of a least-squares problem; coordinate descent finds their
non-negative repeat counts, which are rounded to what the histogram holds. What
is left is packed greedily, longest first. Pieces take their places by their
rank within their length, which is counted in salted groups.

Defined cases: a null or empty text is the end id alone, one piece of length 1;
repeated rows are packed as often as they occur; a text of any length is cut,
never shortened; columns beside doc_id and text are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bpe, default_path
from .common import materialize, parts, small_batches, table, text_or_empty

WINDOW, END_ID, SWEEPS = 2048, 1, 4
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Every way to fill the window with up to three of the lengths, longest part first."""
    have = set(lengths)
    found: list[tuple[int, ...]] = [(a,) for a in lengths if a == window]
    found += [(a, window - a) for a in lengths if 2 * a >= window and window - a in have]
    for a in sorted(have, reverse=True):
        rest = window - a
        found += [(a, b, rest - b) for b in lengths if b <= a and rest - b in have and 0 < rest - b <= b]
    return found


def nnls(columns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the columns' sum near the histogram, by cyclic coordinate descent."""
    rest = {k: float(v) for k, v in histogram.items()}
    counts = [(tuple((k, c.count(k)) for k in dict.fromkeys(c)), sum(c.count(k) ** 2 for k in set(c))) for c in columns]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, (own, norm) in enumerate(counts):
            step = 0.0
            for k, m in own:
                step += m * rest[k]
            step /= norm
            if step < -x[j]:
                step = -x[j]
            if -1e-3 < step < 1e-3:
                continue
            x[j] += step
            moved += abs(step)
            for k, m in own:
                rest[k] -= m * step
        if moved < 1e-2:
            break
    return np.array(x)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of the sequences that use up the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v > 0 and k < window}
    columns = combinations(sorted(left), window)
    x = nnls(columns, left) if columns else np.zeros(0)
    made: list[tuple[int, tuple[int, ...]]] = []
    for j in np.argsort(-x, kind="stable"):
        if (n := int(x[j] + 0.5)) < 1:
            break
        c = columns[j]
        n = min(n, *(left[k] // c.count(k) for k in c))
        if n > 0:
            made.append((n, c))
            for k in c:
                left[k] -= n
    sizes = sorted(k for k, v in left.items() if v > 0)
    while sizes:
        used: dict[int, int] = {}
        room = window
        order: list[int] = []
        while sizes and room >= sizes[0]:
            i = bisect.bisect_right(sizes, room) - 1
            while i >= 0 and left[sizes[i]] <= used.get(sizes[i], 0):
                i -= 1
            if i < 0:
                break
            used[sizes[i]] = used.get(sizes[i], 0) + 1
            order.append(sizes[i])
            room -= sizes[i]
        n = min(left[k] // m for k, m in used.items())
        made.append((n, tuple(order)))
        for k, m in used.items():
            left[k] -= n * m
        sizes = [k for k in sizes if left[k] > 0]
    return made


class Places:
    """Where the piece of a length and a rank goes."""

    def __init__(self, made: list[tuple[int, tuple[int, ...]]]):
        runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        rank: dict[int, int] = {}
        self.sequences = 0
        for n, lengths in made:
            at, offsets = 0, {}
            for k in lengths:
                offsets.setdefault(k, []).append(at)
                at += k
            for k, o in offsets.items():
                runs.setdefault(k, []).append((rank.get(k, 0), self.sequences, len(o), o))
                rank[k] = rank.get(k, 0) + n * len(o)
            self.sequences += n
        self.runs = {k: ([r[0] for r in v], v) for k, v in runs.items()}

    def of(self, length: int, rank: int) -> tuple[int, int]:
        starts, runs = self.runs[length]
        first, base, m, offsets = runs[bisect.bisect_right(starts, rank) - 1]
        q = rank - first
        return base + q // m, offsets[q % m]


def cut(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of each document's ids followed by the end id."""

    def run(batches):
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(bpe(path).encode(batch.column(1).to_pylist())):
                n, data = len(ids) + 1, ids.astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                for s in range(0, n, window):
                    part = data[4 * s : 4 * (s + window)]
                    rows.append((k, s, len(part) // 4, zlib.crc32(part), n))
            at, *numbers = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, numbers)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    path = path or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    salts = parts(spark)
    pieces = materialize(cut(docs, path, window).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, window))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .drop("salt", "base")
    )
    held = spark.sparkContext.broadcast(places)  # as large as the window asks, whatever the corpus

    def placed(batches):
        p = held.value
        for batch in batches:
            length, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            got = np.array([(p.sequences + r, 0) if n == window else p.of(n, r) for n, r in zip(length, rank)], np.int64).reshape(-1, 2)
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, got.T)], [*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(placed, PIECE + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
