"""Line dedup by a log-template tree of fixed depth.

A line's tokens are its words; a token with a digit is a variable field from
the start. The tree branches by token count and then by the ``depth`` leading
tokens (``LEAD`` unless stated; op1 and the pipeline pass 1, so that a field among
the first words can vary). In a leaf, lines join in order of first occurrence (doc_id, line) the
template that equals them in most places, if that is at least ``PERCENT`` per
cent of the tokens, variable ones included, and in half of them word for word;
fields that differ become variable. Other lines found templates of their own. A template that two documents or more use recurs: all
its lines go but its first occurrence. Lines of fewer than ``least`` tokens
(``LEAST`` unless stated; op1 and the pipeline pass 1, so every line with a word
enters the tree) are left alone. Lines that are mostly variable, as rows of
numbers are, recur only word for word, digits included. Lines of up to ``LEAD`` tokens share a leaf, and a template, only
where all their tokens agree, whatever ``depth`` is.

Most leaves hold one line and need no text: lines first meet as hashes of leaf
and line, bucketed, and a task sends one entry for a line that it holds many
times. Only where a leaf has several distinct lines do their tokens travel.

Defined cases: null or empty texts have no lines; white space inside a line
doesn't count; lines that repeat within one document only stay; repeated rows
(same doc_id) count as one document, so their lines stay or go together; a
null doc_id comes before all others; columns beside doc_id and text pass
through ``line_dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, bucketwise, frame, ids_back, keyed, materialize, meet, rebuilt, rows_frame, small_batches, table, with_packs
from .substring_dedup import MINE, SPOTS, _spots, settled, texts_of
from .vectors import CHUNK, U, Words, _between, _sums, dealt, joined, mix, pack, runs, spread, squeezed, unsqueezed

LEAD, LEAST, PERCENT = 4, 5, 80
FIELD = b"<*>"
WILD = 0
#: Hashes of a field's name and of the leaves of lines that are matched word for word.
FIELD_CODE, EXACT = U(xxhash.xxh3_64_intdigest(FIELD) | 1), U(0x94D049BB133111EB)


class Lines:
    """The lines of several texts that have ``least`` words or more, in order.

    ``text`` and ``place`` (its number in the text) of each line, ``leaf`` and
    ``line`` their hashes, ``exact`` whether it is matched word for word,
    ``first`` and ``width`` its words in ``code``, which is WILD for a field.
    """

    def __init__(self, raw: list[bytes], least: int, depth: int):
        w = Words(raw)
        breaks = np.cumsum(w.buffer == 10)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
        number = breaks[w.start]  # of the line that a word stands in, over all texts
        first = runs(number)[:-1] if len(number) else np.zeros(0, np.int64)
        width = np.diff(np.append(first, len(number)))
        digits = np.concatenate([[0], np.cumsum((w.buffer >= 48) & (w.buffer <= 57))])
        field = digits[w.end] > digits[w.start]
        named = np.flatnonzero((w.end - w.start == 3) & (w.buffer[w.start] == FIELD[0]))
        field[named[(w.buffer[w.start[named] + 1] == FIELD[1]) & (w.buffer[w.start[named] + 2] == FIELD[2])]] = True
        exact = 2 * np.add.reduceat(field, first, dtype=np.int64) > width if len(first) else np.zeros(0, bool)
        masked = field & ~np.repeat(exact, width)
        hashes = w.word_hash()
        self.code = np.where(masked, U(WILD), hashes | U(1))
        sums = _sums(np.where(masked, FIELD_CODE, hashes), 0)
        line = _between(sums, first, first + width, 0)
        lead = np.where(width > LEAD, np.minimum(depth, width), np.minimum(LEAD, width))
        leaf = mix(_between(sums, first, first + lead, 0) ^ mix(width.astype(U)))
        leaf = np.where(exact, mix(line ^ EXACT), leaf)
        k = np.flatnonzero(width >= least)
        self.text, self.line, self.leaf, self.exact, self.first, self.width = w.text[first[k]], line[k], leaf[k], exact[k], first[k], width[k]
        self.place = (number[first[k]] - (breaks[begins] - (w.buffer[begins] == 10))[self.text]).astype(np.int32)


class Leaf:
    """The templates of one leaf, as rows of word codes.

    A line differs from its template in at most a fixed number of words that
    aren't fields, so of one block of words more than that at least one is
    equal: templates without fields are looked up by their blocks. Only those
    with fields are compared with every line.
    """

    def __init__(self, width: int):
        self.rows = np.zeros((4, width), U)
        self.used = 0
        self.fields: list[int] = []
        self.blocks: dict[int, list[int]] = {}
        self.same: dict[bytes, int] = {}

    def place(self, codes: np.ndarray, blocks: list[int]) -> int:
        name = codes.tobytes()
        found = self.same.get(name)
        if found is None:
            found = self.same[name] = self._place(codes, blocks)
        return found

    def _place(self, codes: np.ndarray, blocks: list[int]) -> int:
        may = set(self.fields)
        for b in blocks:
            may.update(self.blocks.get(b, ()))
        if may:
            at = np.array(sorted(may))
            known = self.rows[at]
            same = ((known == codes) & (known != WILD)).sum(axis=1)
            wild = (known == WILD).sum(axis=1)
            fits = (100 * (same + wild) >= PERCENT * len(codes)) & (2 * same >= len(codes))
            if fits.any():
                k = int(np.where(fits, same, -1).argmax())
                best = int(at[k])
                row = self.rows[best]
                differs = row != codes
                if differs.any() and not wild[k]:
                    self.fields.append(best)
                row[differs] = WILD
                return best
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = codes
        if (codes == WILD).any():
            self.fields.append(self.used)
        else:
            for b in blocks:
                self.blocks.setdefault(b, []).append(self.used)
        self.used += 1
        return self.used - 1


def line_classes(docs: DataFrame, buckets: int, least: int, depth: int) -> DataFrame:
    """Lines that go, and lines whose leaf has others, packed by document bucket."""

    def parse(batches):
        for batch in batches:
            for raw, doc, own in texts_of(batch):
                x = Lines(raw, least, depth)
                text, place, leaf, line = x.text, x.place, x.leaf, x.line
                if not len(text):
                    continue
                d = doc[text]
                order = np.lexsort((place, d, line, leaf))
                cut = runs(leaf[order], line[order])
                size = np.diff(cut)
                lead = np.repeat(order[cut[:-1]], size)
                other = d[order] != d[lead]
                gone = np.sort(order[other])
                rows = _spots(own[text[gone]], np.zeros(len(gone), np.uint8), d[gone], place[gone])
                multi = np.repeat(np.maximum.reduceat(other, cut[:-1]), size).astype(np.uint8)
                stay = np.flatnonzero(~other)
                k, m = order[stay], multi[stay]
                back = np.argsort(k)
                k, m = k[back], m[back]
                rows += [(b, -1, blob) for b, blob in dealt((leaf[k] % U(buckets)).astype(np.int32), leaf[k], line[k], m, d[k], own[text[k]], place[k])]
                yield rows_frame(rows, MINE)

    def meet_lines(group: pa.Table) -> pa.Table:
        rows, packs = settled(group)
        leaf, line, multi, doc, own, place = joined(packs, ("u8", "u8", "u1", "i8", "i4", "i4"))
        if len(leaf):
            order = np.lexsort((place, doc, line, leaf))
            leaf, line, multi, doc, own, place = (c[order] for c in (leaf, line, multi, doc, own, place))
            cls = runs(leaf, line)
            size = np.diff(cls)
            lead = np.repeat(cls[:-1], size)
            late = doc != doc[lead]
            across = np.maximum.reduceat(late | (multi > 0), cls[:-1])  # the line is in two documents
            by_leaf = runs(leaf[cls[:-1]])
            alone = np.repeat(np.diff(by_leaf) == 1, np.diff(by_leaf))  # of a class: its leaf has no other
            alone, across = np.repeat(alone, size), np.repeat(across, size)
            first = np.arange(len(leaf)) == lead
            same_spot = (doc == doc[lead]) & (place == place[lead])  # a repeated row
            gone = (late | (across & ~first)) & ~same_spot
            open_ = ~alone & ~gone & (first | ~across)
            what = np.where(open_, np.where(across, 2, 1), 0).astype(np.uint8)
            take = np.flatnonzero(gone | open_)
            take = take[np.lexsort((place[take], doc[take]))]
            rows += dealt(own[take], what[take], doc[take], place[take])
        return pa.Table.from_batches([rows_frame(rows, SPOTS)])

    return docs.mapInArrow(parse, MINE).groupBy("bucket").applyInArrow(meet_lines, SPOTS)


def _by_doc(packs: list[bytes], opened: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and kinds of each document's open lines, or of those that go."""
    what, doc, place = joined(packs, ("u1", "i8", "i4"))
    m = (what > 0) == opened
    what, doc, place = what[m], doc[m], place[m]
    order = np.argsort(doc, kind="stable")
    cut = runs(doc[order])
    return {int(doc[order[a]]): (place[order[a:b]], what[order[a:b]]) for a, b in zip(cut[:-1], cut[1:])}


def _opened(x: Lines, doc: np.ndarray, by: dict) -> tuple[np.ndarray, np.ndarray]:
    """The lines that are open, and their kinds; an exact line is its leaf's only one."""
    ends = np.searchsorted(x.text, np.arange(len(doc) + 1))
    take, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for i, d in enumerate(doc.tolist()):
        place, what = by[d]
        order = np.argsort(place)
        place, what = place[order], what[order]
        own = x.place[ends[i] : ends[i + 1]]
        at = np.minimum(np.searchsorted(place, own), len(place) - 1)
        k = np.flatnonzero((place[at] == own) & ~x.exact[ends[i] : ends[i + 1]])
        take.append(k + ends[i])
        kind.append(what[at[k]])
    return np.concatenate(take), np.concatenate(kind)


def template_lines(docs: DataFrame, classes: DataFrame, buckets: int, least: int, depth: int) -> DataFrame:
    """Lines that go by the templates of leaves with several lines, packed by document bucket."""

    def send(batches):
        for by, part in bucketwise(batches, lambda packs: _by_doc(packs, True)):
            part = part.filter(pa.array([d in by for d in part.field("doc").to_pylist()], pa.bool_()))
            rows = []
            for raw, doc, own in texts_of(part):
                x = Lines(raw, least, depth)
                k, what = _opened(x, doc, by)
                if not len(k):
                    continue
                bucket = (x.leaf[k] % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = runs(bucket[order])
                for a, b in zip(cut[:-1], cut[1:]):
                    o = order[a:b]
                    j = k[o]
                    head = pack(x.leaf[j], what[o] - 1, doc[x.text[j]], own[x.text[j]], x.place[j], x.width[j].astype(np.int32))
                    rows.append((int(bucket[o[0]]), -1, len(head).to_bytes(4, "little") + head + squeezed(x.code[spread(x.first[j], x.width[j])])))
            if rows:
                yield rows_frame(rows, MINE)

    def grow(group: pa.Table) -> pa.Table:
        blobs = group["blob"].to_pylist()
        sizes = [int.from_bytes(b[:4], "little") for b in blobs]
        leaf, multi, doc, own, place, width = joined([b[4 : 4 + n] for b, n in zip(blobs, sizes)], ("u8", "u1", "i8", "i4", "i4", "i4"))
        code = np.frombuffer(b"".join([unsqueezed(b[4 + n :]) for b, n in zip(blobs, sizes)]), U)
        gone = [np.zeros(0, np.int64)]
        if len(leaf):
            order = np.lexsort((place, doc, leaf))
            begin, width = (np.cumsum(width, dtype=np.int64) - width)[order], width[order].astype(np.int64)
            leaf, multi, doc, own, place, code = leaf[order], multi[order], doc[order], own[order], place[order], code[spread(begin, width)]
            begin = np.cumsum(width) - width
            gone += _late_lines(leaf, multi, doc, place, code, begin, width)
        k = np.concatenate(gone)
        k = k[np.lexsort((place[k], doc[k]))]
        return pa.Table.from_batches([rows_frame(list(dealt(own[k], np.zeros(len(k), np.uint8), doc[k], place[k])), SPOTS)])

    rows = docs.select("own", F.struct("doc", "text", "own").alias("row"))
    return meet(rows, classes).mapInArrow(send, MINE).groupBy("bucket").applyInArrow(grow, SPOTS)


def _late_lines(leaf, multi, doc, place, code, begin, width) -> Iterator[np.ndarray]:
    """The lines that go by each template, of lines sorted by leaf and occurrence.

    A leaf without a field whose lines share no block keeps them all: no line
    joins another's template.
    """
    blocks = width * (100 - PERCENT) // 100 + 1
    at = np.arange(len(code)) - np.repeat(begin, width)
    block = at * np.repeat(blocks, width) // np.repeat(width, width)
    cut = np.flatnonzero((block != np.concatenate([[-1], block[:-1]])) | (at == 0))
    of = np.repeat(np.arange(len(leaf)), blocks)
    name = np.add.reduceat(mix(code + (at.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)), cut)
    name = mix(name ^ mix(leaf[of] + block[cut].astype(U)))
    order = np.argsort(name, kind="stable")
    shared = np.repeat(np.diff(runs(name[order])) > 1, np.diff(runs(name[order])))
    live = np.logical_or.reduceat(code == WILD, begin)
    live[of[order[shared]]] = True
    first = np.cumsum(blocks) - blocks
    cuts = runs(leaf)
    alive = np.logical_or.reduceat(live, cuts[:-1])
    for a, b in zip(cuts[:-1][alive].tolist(), cuts[1:][alive].tolist()):
        if b - a == 1:
            continue
        tree = Leaf(int(width[a]))
        kind = np.array([tree.place(code[begin[i] : begin[i] + width[i]], name[first[i] : first[i] + blocks[i]].tolist()) for i in range(a, b)])
        order = np.argsort(kind, kind="stable")
        ends = runs(kind[order])
        for lo, hi in zip(ends[:-1], ends[1:]):
            own_lines = order[lo:hi] + a
            if len(own_lines) > 1 and (multi[own_lines].any() or (doc[own_lines] != doc[own_lines[0]]).any()):
                rest = own_lines[1:]
                yield rest[(doc[rest] != doc[own_lines[0]]) | (place[rest] != place[own_lines[0]])]


def dropped_lines(docs: DataFrame, least: int = LEAST, depth: int = LEAD) -> tuple[DataFrame, int]:
    """The lines that go, packed by document bucket, and the number of buckets."""
    small_batches(docs.sparkSession)
    buckets = bucket_count(docs)
    own = keyed(docs, buckets)
    classes = materialize(line_classes(own, buckets, least, depth))
    return classes.union(materialize(template_lines(own, classes, buckets, least, depth))), buckets


def without(text: str, gone: np.ndarray | None) -> tuple[int, int, str]:
    """(lines with a word, lines that go, the text of the others)."""
    lines = text.split("\n")
    n = sum(1 for x in lines if x.strip(" \t\r\x0b\x0c"))
    if gone is None:
        return n, 0, text
    out = set(gone.tolist())
    kept = [x for i, x in enumerate(lines) if i not in out]
    return n, len(lines) - len(kept), "\n".join(kept)


def line_dedup(docs: DataFrame, least: int = LEAST, depth: int = LEAD) -> DataFrame:
    """``docs`` with the lines left; documents that lose every line with a word are not among them."""
    gone, buckets = dropped_lines(docs, least, depth)

    def cut(batches):
        for by, part in bucketwise(batches, lambda packs: _by_doc(packs, False)):
            keep, new = [], []
            for d, t in zip(part.field("doc").to_pylist(), part.field("text").to_pylist()):
                lines = by.get(d, (None,))[0]
                if t is not None and lines is not None:
                    *_, t = without(t, lines)
                    keep.append(bool(t.strip(" \t\n\r\x0b\x0c")))
                else:
                    keep.append(True)
                new.append(t)
            yield rebuilt(part.field("whole"), new, keep)

    return with_packs(docs, gone, buckets).mapInArrow(cut, docs.schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_dropped, kept_sha256 of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone, buckets = dropped_lines(docs, least=1, depth=1)
    result = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"

    def digest(batches):
        for by, part in bucketwise(batches, lambda packs: _by_doc(packs, False)):
            doc = part.field("doc").to_pylist()
            told = [without(t or "", by.get(d, (None,))[0]) for d, t in zip(doc, part.field("text").to_pylist())]
            n, out, rest = zip(*told)
            yield frame([ids_back(doc), n, out, [hashlib.sha256(t.encode()).hexdigest() for t in rest]], result)

    return with_packs(docs, gone, buckets).mapInArrow(digest, result)
