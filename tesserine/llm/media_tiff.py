"""Media columns: texts stored as TIFF images, read back page by page.

A payload is UTF-8 padded with blanks to rows of 64 pixels of three samples. A
file has pages of at most ``PAGE_ROWS`` rows, deflated in strips with
horizontal differencing.

Defined cases: a null or empty text is one row of blanks; a text of any length
takes as many pages as it needs; repeated rows give equal files; ``tiff_pages``
gives no row for a null file and one with an error in place of its pages for a
file that can't be read; doc_id passes through as it is; columns beside doc_id
and text (or media) are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tiff
from .common import frame, rows_frame, small_batches, table, text_or_empty

ROW, PAGE_ROWS = 192, 4096


def encode_payload(payload: bytes) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return tiff.write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)])


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def feature(pixels: np.ndarray) -> str:
    """Mean, deviation and a 64-bit brightness hash of eight by nine areas."""
    flat = pixels.reshape(len(pixels), -1)
    total = flat.sum(axis=1, dtype=np.float64)
    mean = total.sum() / flat.size
    counts = np.bincount(flat.ravel(), minlength=256)
    deviation = float(np.sqrt(max(0.0, (counts * (np.arange(256) - mean) ** 2).sum() / flat.size)))
    rows = np.linspace(0, len(flat), 9).astype(int)
    columns = np.linspace(0, flat.shape[1], 10).astype(int)
    summed = np.zeros((len(flat) + 1, flat.shape[1]), np.int64)
    np.cumsum(flat, axis=0, dtype=np.int64, out=summed[1:])
    bands = np.add.reduceat(summed[rows[1:]] - summed[rows[:-1]], columns[:-1], axis=1)
    bits = (bands[:, 1:] > bands[:, :-1]).ravel()
    return f"{mean:.4f}|{deviation:.4f}|{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def tiff_pages(media: DataFrame) -> DataFrame:
    """A row for each page of the files in column media: doc_id, page, width, height, samples, pixels; error where a file can't be read."""
    schema = "page int, width int, height int, samples int, pixels binary, error string"

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    pages = [(p.number, p.width, p.height, p.samples, p.pixels.tobytes(), None) for p in tiff.read_pages(data)]
                except (ValueError, struct.error, zlib.error, IndexError, KeyError) as error:
                    pages = [(None, None, None, None, None, f"{type(error).__name__}: {error}")]
                at += [k] * len(pages)
                rows += pages
            told = rows_frame(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *told.columns], ["doc_id", *told.schema.names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, {schema}")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as a TIFF file in column media."""

    def run(batches):
        for batch in batches:
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            yield frame([batch.column(0), [len(r) for r in raw], [encode_payload(padded(r)) for r in raw]], "doc_id long, n_bytes long, media binary")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def op7_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    result = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digests(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                pixels = np.concatenate([p.pixels for p in tiff.read_pages(data)])
                back = pixels.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(pixels)))
            told = rows_frame(rows, result)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told.columns], ["doc_id", "n_bytes", *told.schema.names])

    return text_media(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(digests, f"doc_id long, n_bytes long, {result}")
