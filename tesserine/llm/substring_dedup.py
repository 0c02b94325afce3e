"""Substring dedup by fixed-block anchors, in words.

Every text is cut into non-overlapping blocks of ``BLOCK`` words, the index;
every rolling window of ``BLOCK`` words probes it. A repeat of ``WINDOW`` words
or more holds a whole block of each of its occurrences, so it is hit whatever
its alignment. Hits are extended: each window of ``WINDOW`` words over a hit is
compared, by a 96-bit hash, with all others of its content, and all but the
first occurrence go. Runs of such windows are the maximal exact repeats.

Entries travel as packed columns, bucketed by hash. A task keeps one entry for
each content that it holds several times and settles the others itself, so a
passage that a third of all texts share is a few entries a task, not one a text.

Defined cases: null or empty texts have no words and nothing to remove; a text
shorter than a window is kept whole; a null doc_id comes before all others;
rows that share a doc_id count as one document: equal rows lose the same words;
columns beside doc_id and text pass through ``substring_dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, bucketwise, frame, ids_back, keyed, materialize, meet, rebuilt, rows_frame, small_batches, table, with_packs
from .vectors import CHUNK, U, Words, chunks, dealt, joined, runs

WINDOW, BLOCK = 20, 10
MINE = "bucket int, own int, blob binary"
SPOTS = "own int, blob binary"


def texts_of(batch: pa.RecordBatch | pa.StructArray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, docs, own) of chunks of a batch."""
    column = batch.field if isinstance(batch, pa.StructArray) else batch.column
    raw = [t.encode() for t in column("text").to_pylist()]
    doc, own = column("doc").to_numpy(), column("own").to_numpy()
    for s in chunks(raw, 2 * CHUNK):
        yield raw[s], doc[s], own[s]


def settled(group: pa.Table) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """(own, blob) of what is on its way to its documents, and the packs that meet here."""
    own, blob = group["own"].to_pylist(), group["blob"].to_pylist()
    return [(o, b) for o, b in zip(own, blob) if o >= 0], [b for o, b in zip(own, blob) if o < 0]


def _spots(own, *columns) -> list[tuple[int, int, bytes]]:
    """Settled places, on their way to their documents."""
    return [(b, b, blob) for b, blob in dealt(own, *columns)]


def anchor_hits(docs: DataFrame, buckets: int, block: int = BLOCK) -> DataFrame:
    """Places (packed doc and word) whose ``block`` words some indexed block also holds."""

    def probe(batches):
        for batch in batches:
            for raw, doc, own in texts_of(batch):
                w = Words(raw)
                at, h = w.windows(block)
                if not len(at):
                    continue
                h >>= U(16)
                order = np.argsort(h, kind="stable")
                cut = runs(h[order])
                size = np.diff(cut)
                first = order[cut[:-1]]
                aligned = np.maximum.reduceat((w.place[at] % block == 0)[order], cut[:-1])
                text, place = w.text[at], w.place[at].astype(np.int32)
                many = order[np.repeat(size > 1, size)]
                many.sort()
                rows = _spots(own[text[many]], doc[text[many]], place[many])
                keep = np.sort(first)
                indexed = np.zeros(len(at), np.uint8)
                indexed[first] = aligned
                t = text[keep]
                rows += [
                    (b, -1, blob)
                    for b, blob in dealt((h[keep] % U(buckets)).astype(np.int32), (h[keep] & U(0xFFFFFFFF)).astype(np.uint32), (h[keep] >> U(32)).astype(np.uint16), indexed[keep], doc[t], own[t], place[keep])
                ]
                yield rows_frame(rows, MINE)

    def hit(group: pa.Table) -> pa.Table:
        rows, packs = settled(group)
        low, high, indexed, doc, own, place = joined(packs, ("u4", "u2", "u1", "i8", "i4", "i4"))
        h = low.astype(U) | high.astype(U) << U(32)
        order = np.argsort(h, kind="stable")
        cut = runs(h[order])
        if len(h):
            size = np.diff(cut)
            found = np.maximum.reduceat(indexed[order], cut[:-1]).astype(bool) & (size > 1)
            spot = np.sort(order[np.repeat(found, size)])
            rows += dealt(own[spot], doc[spot], place[spot])
        return pa.Table.from_batches([rows_frame(rows, SPOTS)])

    return docs.mapInArrow(probe, MINE).groupBy("bucket").applyInArrow(hit, SPOTS)


def _by_doc(blobs) -> dict[int, np.ndarray]:
    doc, place = joined(blobs, ("i8", "i4"))
    order = np.argsort(doc, kind="stable")
    cut = runs(doc[order])
    return {int(doc[order[a]]): place[order[a:b]] for a, b in zip(cut[:-1], cut[1:])}


def repeated_windows(docs: DataFrame, hits: DataFrame, buckets: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Places of windows whose words also start earlier, packed by document bucket."""

    def extend(batches):
        for by, part in bucketwise(batches, _by_doc):
            part = part.filter(pa.array([d in by for d in part.field("doc").to_pylist()], pa.bool_()))
            for raw, doc, own in texts_of(part):
                rows = extended(raw, doc, own, by)
                if rows:
                    yield rows_frame(rows, MINE)

    def extended(raw, doc, own, by) -> list[tuple[int, int, bytes]]:
        w = Words(raw)
        near = np.zeros(len(w.start) + 1, np.int32)
        for i, d in enumerate(doc.tolist()):
            p = by[d]
            p = p[p < w.count[i]] + w.first[i]
            np.add.at(near, np.maximum(p - (window - block), w.first[i]), 1)
            np.add.at(near, p + 1, -1)
        at, h0 = w.windows(window)
        take = np.cumsum(near)[at] > 0
        at, h0 = at[take], h0[take]
        if not len(at):
            return []
        h1 = (w.hash_at(at, window, lane=1) >> U(32)).astype(np.uint32)
        text, place = w.text[at], w.place[at].astype(np.int32)
        order = np.lexsort((place, doc[text], h1, h0))
        cut = runs(h0[order], h1[order])
        first = np.zeros(len(at), bool)
        first[order[cut[:-1]]] = True
        # equal rows hold the same places: those are no earlier ones
        again = ~first
        lead = np.empty(len(at), np.int64)
        lead[order] = np.repeat(order[cut[:-1]], np.diff(cut))
        again &= (doc[text] != doc[text[lead]]) | (place != place[lead])
        a, k = np.flatnonzero(again), np.flatnonzero(first)
        rows = _spots(own[text[a]], doc[text[a]], place[a])
        rows += [(b, -1, blob) for b, blob in dealt((h0[k] % U(buckets)).astype(np.int32), h0[k], h1[k], doc[text[k]], own[text[k]], place[k])]
        return rows

    def earliest(group: pa.Table) -> pa.Table:
        rows, packs = settled(group)
        h0, h1, doc, own, place = joined(packs, ("u8", "u4", "i8", "i4", "i4"))
        if len(h0):
            order = np.lexsort((place, doc, h1, h0))
            cut = runs(h0[order], h1[order])
            lead = np.repeat(order[cut[:-1]], np.diff(cut))
            late = order[(doc[order] != doc[lead]) | (place[order] != place[lead])]
            late.sort()
            rows += dealt(own[late], doc[late], place[late])
        return pa.Table.from_batches([rows_frame(rows, SPOTS)])

    rows = docs.select("own", F.struct("doc", "text", "own").alias("row"))
    return meet(rows, hits).mapInArrow(extend, MINE).groupBy("bucket").applyInArrow(earliest, SPOTS)


def kept_words(raw: bytes, starts: np.ndarray, window: int = WINDOW) -> tuple[int, int, list[bytes]]:
    """Words of the text, removed words, and the words left when the windows at ``starts`` go."""
    words = raw.split()
    n = len(words)
    if not len(starts):
        return n, 0, words
    mark = np.zeros(n + 1, np.int32)
    starts = np.unique(starts)
    starts = starts[starts + window <= n]
    mark[starts] += 1
    np.add.at(mark, starts + window, -1)
    gone = np.cumsum(mark[:-1]) > 0
    return n, int(gone.sum()), [w for w, g in zip(words, gone.tolist()) if not g]


def _removed(docs: DataFrame, window: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    small_batches(docs.sparkSession)
    buckets = bucket_count(docs)
    own = keyed(docs, buckets)
    hits = materialize(anchor_hits(own, buckets, block))
    return own, materialize(repeated_windows(own, hits, buckets, window, block)), buckets


def substring_dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` without the repeated words: kept words stay apart by the white space before them.

    A text that loses nothing stays as it is.
    """
    _, gone, buckets = _removed(docs, window, block)

    def left(text: str, starts: np.ndarray) -> str:
        raw = text.encode()
        w = Words([raw])
        s = np.unique(starts)
        s = s[s + window <= len(w.start)]
        mark = np.zeros(len(w.start) + 1, np.int32)
        np.add.at(mark, s, 1)
        np.add.at(mark, s + window, -1)
        stay = np.cumsum(mark[:-1]) == 0
        before = np.concatenate([[0], w.end[:-1]])
        return b"".join([raw[a:b] for a, b in zip(before[stay].tolist(), w.end[stay].tolist())]).strip(b" \t\n\r\x0b\x0c").decode()

    def cut(batches):
        for by, part in bucketwise(batches, _by_doc):
            new = [t if t is None or d not in by else left(t, by[d]) for d, t in zip(part.field("doc").to_pylist(), part.field("text").to_pylist())]
            yield rebuilt(part.field("whole"), new)

    return with_packs(docs, gone, buckets).mapInArrow(cut, docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, gone, buckets = _removed(docs, WINDOW, BLOCK)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def digest(batches):
        none = np.zeros(0, np.int32)
        for by, part in bucketwise(batches, _by_doc):
            doc = part.field("doc").to_pylist()
            n, removed, kept = zip(*(kept_words((t or "").encode(), by.get(d, none)) for d, t in zip(doc, part.field("text").to_pylist())))
            yield frame([ids_back(doc), n, removed, [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]], result)

    return with_packs(docs, gone, buckets).mapInArrow(digest, result)
