"""Exact substring dedup by suffix sorting, in bytes.

Only suffixes that can repeat are sorted. Every stretch of ``LENGTH`` bytes
elects the smallest hash among its ``GRAM``-byte runs; equal stretches elect
the same run, so stretches can only be equal around elected runs ("anchors")
that occur twice. An anchor's context is all stretches that hold it. Anchors
whose whole context occurs elsewhere are settled where they meet; where one
anchor has several contexts, the contexts travel to the anchor's task, and
their suffixes are ordered there by deep-shallow sorting: a multikey quicksort
with eight-byte digits to a shallow depth, then blind tries, which keep only
branching places, for the groups that still agree. Suffixes that end in one
leaf share ``LENGTH`` bytes.

An anchor with more than ``WIDE`` contexts is split by the bytes on either side
of it, so that a passage in a large share of all texts meets in many tasks.

Defined cases: null or empty texts have no bytes; a text below ``LENGTH`` bytes
is kept whole; repeated rows are copies of each other and lose what copies
lose; rows that share a doc_id share what is removed; a null doc_id counts as
one more id; columns beside doc_id and text pass through ``suffix_dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, bucketwise, frame, ids_back, keyed, materialize, meet, rebuilt, rows_frame, small_batches, table, with_packs
from .substring_dedup import MINE, SPOTS, _spots, settled as settled_rows
from .vectors import U, _between, _bytes_table, _sums, chunks, dealt, joined, mix, pack, runs, unpack

LENGTH, GRAM, SHALLOW, WIDE, SIDE = 200, 40, 16, 2048, 80
#: Bytes of contexts that are sorted together, if no single anchor has more.
SORTED = 4 << 20
SETTLED, NEED, NEED_SETTLED, WIDE_FLAG = 0, 1, 2, 4


def sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + size] for every i that has so many, in linear time."""
    n = len(x) - size + 1
    pad = -len(x) % size
    blocks = np.concatenate([x, np.full(pad, x[-1])]).reshape(-1, size)
    left = best.accumulate(blocks, axis=1).ravel()
    right = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[:n], left[size - 1 : size - 1 + n])


def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(text, place in the buffer, gram hash) of the runs that some stretch inside a text elects."""
    span = length - gram + 1
    sums = _sums(_bytes_table(0)[buffer], 0)
    at = np.arange(len(buffer) - gram + 1)
    h = _between(sums, at, at + gram, 0)
    del sums, at
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    least = sliding(h, span, np.minimum)
    inside = np.zeros(len(least) + 1, np.int8)
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    least[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(span - 1, U)
    most = sliding(np.concatenate([edge, least, edge]), span, np.maximum)[: len(h)]
    place = np.flatnonzero(most == h)
    return np.searchsorted(ends, place, side="right"), place, h[place]


def _chunks(batch: pa.RecordBatch | pa.StructArray, limit: int = 1 << 20):
    """(buffer, starts, ends, docs, own) of chunks of a batch; texts are separated by a zero byte."""
    column = batch.field if isinstance(batch, pa.StructArray) else batch.column
    raw = [t.encode() for t in column("text").to_pylist()]
    doc, own = column("doc").to_numpy(), column("own").to_numpy()
    for s in chunks(raw, limit):
        part = raw[s]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        yield np.frombuffer(b"\0".join(part) + b"\0", np.uint8), ends - sizes, ends, doc[s], own[s]


def anchor_classes(docs: DataFrame, buckets: int, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """Anchors that occur twice, packed by document bucket: what is known of each, doc and place."""

    def elect(batches):
        for batch in batches:
            for buffer, starts, ends, doc, own in _chunks(batch):
                if len(buffer) < length:
                    continue
                text, p, h = anchors(buffer, starts, ends, length, gram)
                if not len(p):
                    continue
                lo = np.maximum(starts[text], p + gram - length)
                hi = np.minimum(p, ends[text] - length) + length
                sums = _sums(_bytes_table(1)[buffer], 1)
                ctx = _between(sums, lo, hi, 1) ^ mix((p - lo).astype(U))
                order = np.lexsort((p, ctx, h))
                cut = runs(h[order], ctx[order])
                size = np.diff(cut)
                several = np.repeat(size > 1, size)
                place = (p - starts[text]).astype(np.int32)
                many = np.sort(order[several])
                rows = _spots(own[text[many]], np.full(len(many), SETTLED, np.uint8), doc[text[many]], place[many])
                first = order[cut[:-1]]
                multi = np.zeros(len(p), np.uint8)
                multi[first] = size > 1
                k = np.sort(first)
                t = text[k]
                rows += [(b, -1, blob) for b, blob in dealt((h[k] % U(buckets)).astype(np.int32), h[k], ctx[k], multi[k], doc[t], own[t], place[k])]
                yield rows_frame(rows, MINE)

    def classify(group: pa.Table) -> pa.Table:
        rows, packs = settled_rows(group)
        h, ctx, multi, doc, own, place = joined(packs, ("u8", "u8", "u1", "i8", "i4", "i4"))
        if len(h):
            order = np.lexsort((place, doc, ctx, h))
            h, ctx, multi, doc, own, place = (c[order] for c in (h, ctx, multi, doc, own, place))
            cls = runs(h, ctx)
            size = np.diff(cls)
            settled = (size > 1) | (np.maximum.reduceat(multi, cls[:-1]) > 0)
            by_h = runs(h[cls[:-1]])
            n_classes = np.repeat(np.diff(by_h), np.diff(by_h))
            need = n_classes > 1
            kind = np.where(need, np.where(settled, NEED_SETTLED, NEED), SETTLED).astype(np.uint8) + np.where(n_classes > wide, WIDE_FLAG, 0).astype(np.uint8)
            lead = np.zeros(len(h), bool)
            lead[cls[:-1]] = True
            what = np.where(lead, np.repeat(kind, size), np.uint8(SETTLED))
            take = np.flatnonzero(np.repeat(settled, size) | (lead & np.repeat(need, size)))
            take = take[np.lexsort((place[take], doc[take]))]
            rows += dealt(own[take], what[take], doc[take], place[take])
        return pa.Table.from_batches([rows_frame(rows, SPOTS)])

    return docs.mapInArrow(elect, MINE).groupBy("bucket").applyInArrow(classify, SPOTS)


def _by_doc(blobs) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    kind, doc, place = joined(blobs, ("u1", "i8", "i4"))
    order = np.argsort(doc, kind="stable")
    cut = runs(doc[order])
    return {int(doc[order[a]]): (kind[order[a:b]], place[order[a:b]]) for a, b in zip(cut[:-1], cut[1:])}


def deep_shallow(digits: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The strings that some other string of their group equals, and the leaf that each ends in.

    ``digits`` holds the eight bytes at every place of the buffer, ``at`` where
    the strings of ``length`` bytes start. Strings whose digits set them apart
    leave the sort as soon as they stand alone.
    """
    live, cls = np.arange(len(at)), group

    def refined(live, cls, digit):
        order = np.lexsort((digit, cls))
        live, cls, digit = live[order], cls[order], digit[order]
        cut = runs(cls, digit)
        size = np.diff(cut)
        keep = np.repeat(size > 1, size)
        return live[keep], np.repeat(np.arange(len(size)), size)[keep]

    depths = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])  # the last digit may overlap
    for depth in [d for d in depths if d < shallow]:  # multikey quicksort on eight-byte digits
        live, cls = refined(live, cls, digits[at[live] + depth])
    columns = np.array([d for d in depths if d >= shallow], np.int64)
    if not len(columns):
        return live, cls
    ended, leaf, leaves = [], [], 0
    while len(live):  # one level of every blind trie at a time: a node knows its branching place only
        cut = runs(cls)
        size = np.diff(cut)
        rest = digits[at[live][:, None] + columns]
        differs = np.logical_or.reduceat(rest != np.repeat(rest[cut[:-1]], size, axis=0), cut[:-1], axis=0)
        branches = differs.any(axis=1)
        keep = np.repeat(branches, size)
        ended.append(live[~keep])
        leaf.append(np.repeat(np.arange(len(size)), size)[~keep] + leaves)
        leaves += len(size)
        place = np.repeat(differs.argmax(axis=1), size)[keep]
        live, cls = refined(live[keep], cls[keep], rest[keep, place])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ended]), np.concatenate([none, *leaf])


def repeated_offsets(digits, anchor, group, o_lo, o_hi, open_, length: int, gram: int):
    """(context, first offset, last offset) of stretches of open contexts that another context of the group has.

    A stretch at offset o starts o bytes before the anchor. A range of offsets
    is settled by two sorts: stretches of the range share the bytes in its
    middle, so a context whose middle stands alone has none of them twice; and
    one whose whole hull another has, has all of them twice. Else the range is
    halved; at a single offset both are the stretch itself.
    """
    out = []
    todo = [(0, length - gram, np.arange(len(anchor)), group, open_)]
    while todo:
        a, b, m, g, want = todo.pop()
        ok = (o_lo[m] <= b) & (o_hi[m] >= a)
        m, g, want = m[ok], g[ok], want[ok]
        live, cls = deep_shallow(digits, anchor[m] - a, g, length - (b - a))
        m, want = m[live], want[live]
        if a < b:
            full = np.flatnonzero((o_lo[m] <= a) & (o_hi[m] >= b))
            hull, _ = deep_shallow(digits, anchor[m[full]] - b, cls[full], length + b - a)
            whole = np.zeros(len(m), bool)
            whole[full[hull]] = True
        else:
            whole = np.ones(len(m), bool)
        hit = m[whole & want]
        if len(hit):
            out.append((hit, a, b))
        want = want & ~whole
        if a < b and want.any():
            order = np.argsort(cls, kind="stable")
            cut = runs(cls[order])
            some = np.repeat(np.logical_or.reduceat(want[order], cut[:-1]), np.diff(cut))
            keep = order[some]
            mid = (a + b) // 2
            todo += [(a, mid, m[keep], cls[keep], want[keep]), (mid + 1, b, m[keep], cls[keep], want[keep])]
    return out


def sorted_contexts(docs: DataFrame, classes: DataFrame, buckets: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Places of stretches that also start elsewhere, by sorting the contexts of anchors with several."""

    def cut_out(batches):
        for by, part in bucketwise(batches, _by_doc):
            part = part.filter(pa.array([d in by and bool((by[d][0] & 3).any()) for d in part.field("doc").to_pylist()], pa.bool_()))
            for chunk in _chunks(part):
                rows = contexts(*chunk, by)
                if rows:
                    yield rows_frame(rows, MINE)

    def contexts(buffer, starts, ends, doc, own, by) -> list[tuple[int, int, bytes]]:
        rows, found = [], []
        for i, d in enumerate(doc.tolist()):
            kind, place = by[d]
            take = (kind & 3 > 0) & (place <= ends[i] - starts[i] - gram)
            p = place[take].astype(np.int64) + starts[i]
            o_hi = p - np.maximum(starts[i], p + gram - length)
            o_lo = p - np.minimum(p, ends[i] - length)
            whole = kind[take] & WIDE_FLAG == 0
            known = (kind[take] & 3 == NEED_SETTLED).astype(np.uint8)
            text = np.full(len(p), i)
            found.append((text[whole], p[whole], o_lo[whole], o_hi[whole], known[whole], np.zeros(whole.sum(), np.int8)))
            w = ~whole
            # stretches with SIDE bytes before the anchor, and the others, which have SIDE bytes after it
            for side in (1, 2):
                lo, hi = (np.maximum(o_lo[w], SIDE), o_hi[w]) if side == 1 else (o_lo[w], np.minimum(o_hi[w], SIDE - 1))
                ok = lo <= hi
                found.append((text[w][ok], p[w][ok], lo[ok], hi[ok], known[w][ok], np.full(ok.sum(), side, np.int8)))
        text, p, o_lo, o_hi, known, side = (np.concatenate(c) for c in zip(*found))
        if not len(p):
            return rows
        sums = _sums(_bytes_table(0)[buffer], 0)
        name = _between(sums, p, p + gram, 0)
        for s, a, b in ((1, p - SIDE, p), (2, p + gram, p + gram + SIDE)):
            m = side == s
            name[m] = mix(name[m] ^ _between(sums, a[m], b[m], 0) ^ U(s))
        order = np.argsort((name % U(buckets)).astype(np.int32), kind="stable")
        bucket = (name % U(buckets)).astype(np.int32)
        cut = runs(bucket[order])
        for x, y in zip(cut[:-1], cut[1:]):
            k = order[x:y]
            body = b"".join([buffer[a:b].tobytes() for a, b in zip((p[k] - o_hi[k]).tolist(), (p[k] - o_lo[k] + length).tolist())])
            head = pack(name[k], known[k], doc[text[k]], own[text[k]], (p[k] - starts[text[k]]).astype(np.int32), o_lo[k].astype(np.uint8), o_hi[k].astype(np.uint8))
            rows.append((int(bucket[order[x]]), -1, len(head).to_bytes(4, "little") + head + pack(np.frombuffer(body, np.uint8))))
        return rows

    def sort(group: pa.Table) -> pa.Table:
        blobs = group["blob"].to_pylist()
        sizes = [int.from_bytes(b[:4], "little") for b in blobs]
        name, known, doc, own, place, o_lo, o_hi = joined([b[4 : 4 + n] for b, n in zip(blobs, sizes)], ("u8", "u1", "i8", "i4", "i4", "u1", "u1"))
        if not len(name):
            return pa.Table.from_batches([rows_frame([], SPOTS)])
        body = np.concatenate([unpack(b[4 + n :])[0] for b, n in zip(blobs, sizes)])
        o_lo, o_hi = o_lo.astype(np.int64), o_hi.astype(np.int64)
        size = o_hi - o_lo + length
        begin = np.cumsum(size) - size
        order = np.argsort(name, kind="stable")
        cut = runs(name[order])
        cut_bytes = np.concatenate([[0], np.cumsum(size[order])])[cut]
        out_own, out_doc, out_place = [], [], []
        lo = 0
        while lo < len(cut) - 1:
            hi = max(lo + 1, int(np.searchsorted(cut_bytes, cut_bytes[lo] + SORTED, side="right")) - 1)
            k = order[cut[lo] : cut[hi]]
            group_of = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
            text = np.concatenate([body[a : a + n] for a, n in zip(begin[k].tolist(), size[k].tolist())] + [np.zeros(8, np.uint8)])
            base = np.cumsum(size[k]) - size[k]
            digits = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(">u8").ravel().astype(U)
            for m, a, b in repeated_offsets(digits, base + o_hi[k], group_of, o_lo[k], o_hi[k], known[k] == 0, length, gram):
                hit = np.repeat(k[m], b - a + 1)
                out_own.append(own[hit])
                out_doc.append(doc[hit])
                out_place.append(place[hit] - np.tile(np.arange(a, b + 1, dtype=np.int32), len(m)))
            lo = hi
        if not out_own:
            return pa.Table.from_batches([rows_frame([], SPOTS)])
        own, doc, place = np.concatenate(out_own), np.concatenate(out_doc), np.concatenate(out_place)
        order = np.lexsort((place, doc))
        return pa.Table.from_batches([rows_frame(list(dealt(own[order], doc[order], place[order])), SPOTS)])

    rows = docs.select("own", F.struct("doc", "text", "own").alias("row"))
    return meet(rows, classes).mapInArrow(cut_out, MINE).groupBy("bucket").applyInArrow(sort, SPOTS)


def covered(size: int, settled: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which bytes go: those of the settled anchors' contexts and of the repeated stretches."""
    mark = np.zeros(size + 1, np.int32)
    if size >= length:
        p = settled[settled + gram <= size]
        np.add.at(mark, np.maximum(0, p + gram - length), 1)
        np.add.at(mark, np.minimum(p, size - length) + length, -1)
        s = starts[(starts >= 0) & (starts + length <= size)]
        np.add.at(mark, s, 1)
        np.add.at(mark, s + length, -1)
    return np.cumsum(mark[:-1]) > 0


#: The first byte of a pack that meets its documents: anchors, or stretches.
ANCHORS, STRETCHES = 0, 1


def removals(docs: DataFrame) -> tuple[DataFrame, int]:
    """(packed settled anchors and repeated stretches by document bucket, buckets)."""
    small_batches(docs.sparkSession)
    buckets = bucket_count(docs)
    own = keyed(docs, buckets)
    classes = materialize(anchor_classes(own, buckets))
    repeated = materialize(sorted_contexts(own, classes, buckets))
    told = (d.select("own", F.concat(F.lit(bytes([k])), "blob").alias("blob")) for k, d in ((ANCHORS, classes), (STRETCHES, repeated)))
    return next(told).union(next(told)), buckets


def gone_bytes(packs: list[bytes]):
    """What tells which bytes of a document go: a function of doc and size."""
    anchors_ = {d: p[(k & 3) != NEED] for d, (k, p) in _by_doc([b[1:] for b in packs if b[0] == ANCHORS]).items()}
    doc, place = joined([b[1:] for b in packs if b[0] == STRETCHES], ("i8", "i4"))
    order = np.argsort(doc, kind="stable")
    cut = runs(doc[order])
    starts = {int(doc[order[a]]): place[order[a:b]] for a, b in zip(cut[:-1], cut[1:])}
    none = np.zeros(0, np.int32)
    return lambda d, size: covered(size, anchors_.get(d, none).astype(np.int64), starts.get(d, none).astype(np.int64))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; bytes that are left of a cut character are dropped with it."""
    gone, buckets = removals(docs)

    def left(of, d: int, text: str) -> str:
        raw = np.frombuffer(text.encode(), np.uint8)
        return raw[~of(d, len(raw))].tobytes().decode("utf-8", "ignore")

    def cut(batches):
        for of, part in bucketwise(batches, gone_bytes):
            new = [None if t is None else left(of, d, t) for d, t in zip(part.field("doc").to_pylist(), part.field("text").to_pylist())]
            yield rebuilt(part.field("whole"), new)

    return with_packs(docs, gone, buckets).mapInArrow(cut, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone, buckets = removals(docs)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches):
        for of, part in bucketwise(batches, gone_bytes):
            doc, rows = part.field("doc").to_pylist(), []
            for d, t in zip(doc, part.field("text").to_pylist()):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                out = of(d, len(raw))
                spans = int(np.count_nonzero(out[1:] & ~out[:-1]) + (len(out) > 0 and bool(out[0])))
                rows.append((len(raw), int(out.sum()), spans, hashlib.sha256(raw[~out].tobytes()).hexdigest()))
            yield frame([ids_back(doc), *zip(*rows)], result)

    return with_packs(docs, gone, buckets).mapInArrow(digest, result)
