"""BPE encoding and decoding through a distinct-word table.

Words are split in Spark workers, those in plain letters, digits and signs into
runs as the tokenizer would. The frequent ones, at most ``FREQUENT`` by a count
over all documents, are encoded once each and broadcast; a document becomes the
ranks of its words in that table, with holes for the others. Every other
distinct word is encoded once where its occurrences meet, and its ids join back
to the documents by position among their holes. Decoding joins each id with its
row of the tokenizer's piece table, whose size is the vocabulary's.

Defined cases: a null text is empty, an empty text has no ids; repeated rows
(same doc_id and text) give equal results each; rows with a null doc_id are
told apart by their text; doc_id passes through as it is, of any type; columns
beside doc_id and text are ignored. A long text is cut at white space into
pieces of about ``CHUNK`` characters while it is split; a word is handled
whole, however long. Control strings of the tokenizer inside a text become its
special ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, text_or_empty
from .merges import LONGEST, Merges
from .vectors import release, spread

#: Words that are broadcast; with their ids some 20 MB.
FREQUENT = 1 << 18
#: Words with counts that a task holds before it adds them up, and characters of text that are cut at once.
HELD, CHUNK = 400_000, 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Separates words for str.split but is no white space to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
FAR_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Starts the word that stands for a control string: no other word has an upper-case letter.
MARK = "S"

#: What a byte of normalised text is. Plain words have letters up to U+024F, ASCII digits and signs without a quote or
#: angle bracket: there the tokenizer's own cut is one into runs of letters, digits and runs of signs.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[ord(c) for c in "'<>"]] = ODD
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK


def kinds(data: np.ndarray) -> np.ndarray:
    found = KIND[data]
    lead = np.flatnonzero((data == 0xC3) | (data == 0xC9))
    lead = lead[lead + 1 < len(data)]
    after = data[lead + 1]
    found[lead[np.where(data[lead] == 0xC3, (after == 0x97) | (after == 0xB7), after > 0x8F)]] = ODD
    return found


class Ids:
    """The ids of many words, one after the other; ``of`` gives those of a run of words."""

    def __init__(self, flat: np.ndarray, count: np.ndarray):
        self.flat, self.count = flat, count
        self.begin = np.cumsum(count) - count

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[words]
        return self.flat[spread(self.begin[words], count)], count

    def and_(self, other: Ids) -> Ids:
        return Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.count, other.count]))

    @staticmethod
    def from_arrow(ids: pa.Array) -> Ids:
        ids = ids.cast(pa.large_binary())
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = ids.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<u2") if data is not None and offsets[-1] > offsets[0] else np.zeros(0, "<u2")
        return Ids(flat, np.diff(offsets) // 2)

    def to_arrow(self) -> pa.Array:
        return binaries(self.flat, self.count)


def binaries(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """Arrow binaries of ``count`` 16-bit numbers each."""
    offsets = np.concatenate([[0], np.cumsum(count) * 2])
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<u2"))])
    return pa.array([flat[a // 2 : b // 2].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


class Cut:
    """The words of several texts: ``words`` the distinct ones, ``code`` the word at each place, ``first`` place of each text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = kinds(data)
        blank = kind == BLANK
        before = np.empty_like(blank)
        before[0], before[1:] = True, blank[:-1]
        start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        odd = np.logical_or.reduceat(kind == ODD, start) if len(start) else np.zeros(0, bool)
        edge = np.flatnonzero(((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & ~blank[1:] & ~blank[:-1]) + 1
        edge = edge[~odd[np.searchsorted(start, edge, side="right") - 1]]
        start, end = np.sort(np.concatenate([start, edge])), np.sort(np.concatenate([end, edge]))
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)])
        self.first = np.searchsorted(start, begins)
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy()


class WordBpe:
    """A tokenizer whose words, the runs without white space, are encoded independently of each other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pieces = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.rules = self.tok.normalizer
        self.tok.normalizer = normalizers.Sequence([])  # words come normalised
        self.tok.encode_special_tokens = True  # control strings are cut out before lower-casing, not after
        self.merges = Merges(path)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if "Σ" in text or "İ" in text:  # where lower() looks at neighbours or adds marks
            return self.rules.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def plain(self, text: str) -> list[str]:
        return [w for w in WHITE.split(text) if w] if ODD_SPACE.search(text) else text.split()

    def ready(self, text: str) -> str:
        """Normalised text, its words apart by ASCII white space and control strings as marked words."""
        if "<|" in text and self.cutter.search(text):
            found: list[str] = []
            for part in self.cutter.split(text):
                found += [MARK + part] if part in self.special else self.plain(self.normal(part))
            return "\n".join(found)
        text = self.normal(text)
        return text if text.isascii() or not FAR_WHITE.search(text) else WHITE.sub(" ", text)

    def cut(self, texts: list[str]) -> Cut:
        return Cut([self.ready(t) for t in texts])

    def encode_words(self, words: pa.Array) -> Ids:
        """The ids of an Arrow array of words."""
        words = words.cast(pa.large_string())
        if not len(words):
            return Ids(np.zeros(0, np.uint16), np.zeros(0, np.int64))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        size, start = np.diff(offsets), offsets[:-1]
        kind = kinds(data)[offsets[0] : offsets[-1]]
        low, high = np.minimum.reduceat(kind, start - offsets[0]), np.maximum.reduceat(kind, start - offsets[0])
        merged = (low == high) & (low != BLANK) & (high != ODD) & ((low != DIGIT) | (size == 1)) & (size <= LONGEST)
        k, rest = np.flatnonzero(merged), np.flatnonzero(~merged)
        flat, count = self.merges.encode(data[spread(start[k], size[k])], size[k])
        odd = words.take(pa.array(rest)).to_pylist()
        told = {w: [self.special[w[1:]]] for w in odd if w[0] == MARK and w[1:] in self.special}
        ask = [w for w in odd if w not in told]
        told |= zip(ask, (e.ids for e in self.tok.encode_batch_fast(ask, add_special_tokens=False)))
        counts = np.zeros(len(words), np.int64)
        counts[k], counts[rest] = count, [len(told[w]) for w in odd]
        begin = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.uint16)
        out[spread(begin[k], count)] = flat
        out[spread(begin[rest], counts[rest])] = [i for w in odd for i in told[w]]
        return Ids(out, counts)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids, in order; of a chunk of texts every distinct word is encoded once."""
        held: list[np.ndarray] = []
        for part, last in text_chunks(texts):
            cut = self.cut(part)
            flat, count = self.encode_words(cut.words).of(cut.code)
            at = np.concatenate([[0], np.cumsum(count)])[cut.first].tolist()
            for a, b, done in zip(at[:-1], at[1:], last):
                held.append(flat[a:b])
                if done:
                    yield held[0] if len(held) == 1 else np.concatenate(held)
                    held = []


def text_chunks(texts: list[str], limit: int | None = None) -> Iterator[tuple[list[str], list[bool]]]:
    """Lists of texts of about ``limit`` characters, and whether each ends its text; a long text is cut at white space."""
    limit = limit or CHUNK
    part, last, held = [], [], 0
    for t in texts:
        at = 0
        while len(t) - at > limit:
            white = re.compile("[ \t-\r]").search(t, at + limit)
            if white is None:
                break
            if part:
                yield part, last
            yield [t[at : white.start()]], [False]
            part, last, held, at = [], [], 0, white.start()
        part.append(t[at:] if at else t)
        last.append(True)
        held += len(t) - at + 1
        if held > limit:
            yield part, last
            part, last, held = [], [], 0
    if part:
        yield part, last
    release()


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> WordBpe:
    return WordBpe(path)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack_ranks(ranks: np.ndarray, rare: list[str]) -> bytes:
    """Word ranks as three byte planes (ranks are below 2 ** 24), then the words of the holes; compressed."""
    planes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return len(ranks).to_bytes(8, "little") + _PACK.compress(planes.tobytes() + "\n".join(rare).encode())


def unpack_ranks(blob: bytes) -> tuple[np.ndarray, list[str]]:
    n, raw = int.from_bytes(blob[:8], "little"), _UNPACK.decompress(blob[8:])
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8, 3 * n).reshape(3, n).T
    rare = raw[3 * n :].decode()
    return wide.view("<u4").ravel(), rare.split("\n") if rare else []


def _counted(path: str):
    def added(parts: list[pa.Table]) -> pa.RecordBatch:
        got = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([got["word"].combine_chunks().cast(pa.string()), got["n_sum"].combine_chunks()], ["word", "n"])

    def run(batches):
        b, parts, held = bpe(path), [], 0
        for batch in batches:
            for part, _ in text_chunks(batch.column(0).to_pylist()):
                cut = b.cut(part)
                parts.append(pa.table({"word": cut.words, "n": np.bincount(cut.code, minlength=len(cut.words))}))
                held += len(cut.words)
            if held > HELD:
                yield added(parts)
                parts, held = [], 0
        if parts:
            yield added(parts)
        release()

    return run


class Frequent:
    """The words that are broadcast, commonest first, with their ids."""

    def __init__(self, words: list[str], ids: Ids):
        self.words, self.ids = words, ids

    @functools.cached_property
    def ranks(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}


def frequent_words(docs: DataFrame, path: str, most: int = FREQUENT) -> Frequent:
    """The words that occur most, ``most`` at most, and at least twice.

    Counts fall into classes of an eighth of a power of two; the classes taken
    are the highest that fit ``most`` together, so no more rows than that reach
    the driver.
    """
    counts = materialize(
        docs.select(text_or_empty().alias("text")).mapInArrow(_counted(path), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
        .select("word", F.floor(F.log2("n") * 8).cast("int").alias("level"))
    )
    least, total = None, 0
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return Frequent([], Ids(np.zeros(0, np.uint16), np.zeros(0, np.int64)))

    def encoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bpe(path).encode_words(b.column(0)).to_arrow()], ["word", "level", "ids"])

    rows = counts.where(F.col("level") >= least).mapInArrow(encoded, "word string, level int, ids binary").toArrow().sort_by([("level", "descending"), ("word", "ascending")])
    return Frequent(rows["word"].to_pylist(), Ids.from_arrow(rows["ids"].combine_chunks()))


def encode_documents(docs: DataFrame, path: str | None = None, most: int = FREQUENT, then: Callable | None = None, schema: str = "") -> DataFrame:
    """doc_id and ids (little-endian unsigned 16-bit numbers) of each row of ``docs``.

    ``then`` takes those batches on in the same worker, to rows of ``schema``.
    """
    path = path or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(frequent_words(docs, path, most))
    hole = len(known.value.words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ranked(batches):
        b, ranks = bpe(path), known.value.ranks
        for batch in batches:
            blobs, streams, rare = [], [], []
            for part, last in text_chunks(batch.column(2).to_pylist()):
                cut = b.cut(part)
                words = cut.words.to_pylist()
                rank = np.fromiter((ranks.get(w, hole) for w in words), np.uint32, len(words))[cut.code]
                gone = np.flatnonzero(rank == hole)
                lost = [words[c] for c in cut.code[gone].tolist()]
                at = np.searchsorted(gone, cut.first).tolist()
                for k, done in enumerate(last):
                    streams.append(rank[cut.first[k] : cut.first[k + 1]])
                    rare += lost[at[k] : at[k + 1]]
                    if done:
                        blobs.append(pack_ranks(np.concatenate(streams), rare))
                        streams, rare = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["doc_id", "key", "blob"])

    def holes(batches):
        seen = set()  # of one partition's documents: equal rows have equal holes
        for batch in batches:
            words, keys, at = [], [], []
            told = zip(*(f.to_pylist() for f in batch.column(1).flatten()))
            for i, (key, blob) in enumerate(zip(told, batch.column(2).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    rare = unpack_ranks(blob)[1]
                    words += rare
                    keys += [i] * len(rare)
                    at += range(len(rare))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(1).take(pa.array(keys, pa.int64())), pa.array(at, pa.int32())], ["word", "key", "at"])

    def encoded(batches):
        b = bpe(path)
        for batch in batches:  # sorted by word: each is encoded once, or once a batch where it fills several
            words = batch.column(0).dictionary_encode()
            flat, count = b.encode_words(words.dictionary).of(words.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), binaries(flat, count)], ["key", "at", "ids"])

    def filled(batches):
        frequent = known.value.ids
        for batch in batches:
            streams = [unpack_ranks(x)[0] for x in batch.column(1).to_pylist()]
            words = np.concatenate(streams).astype(np.int64) if streams else np.zeros(0, np.int64)
            rare = Ids.from_arrow(batch.column(2).flatten())
            gone = np.flatnonzero(words == hole)
            if len(gone) != len(rare.count):
                raise ValueError(f"{len(gone)} words without a rank, {len(rare.count)} with ids")
            words[gone] = hole + np.arange(len(gone))
            flat, count = frequent.and_(rare).of(words)
            ends = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))
            at = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], ends])]
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(flat, np.diff(at))], ["doc_id", "ids"])

    key = F.struct(F.xxhash64("doc_id", text_or_empty()).alias("a"), F.xxhash64(F.lit(1), text_or_empty(), F.col("doc_id")).alias("b"))
    keyed = docs.select("doc_id", key.alias("key"), text_or_empty().alias("text"))
    # one exchange that both sides read: whole blobs, so nothing is pruned on one side only
    ranks = keyed.mapInArrow(ranked, f"doc_id {kind}, key struct<a: bigint, b: bigint>, blob binary").repartition("key")
    told = (
        ranks.mapInArrow(holes, "word string, key struct<a: bigint, b: bigint>, at int")
        .repartition("word").sortWithinPartitions("word")
        .mapInArrow(encoded, "key struct<a: bigint, b: bigint>, at int, ids binary")
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("rare"))
    )
    def finished(batches):
        yield from then(filled(batches))
        release()

    both = ranks.join(told, "key", "left").select("doc_id", "blob", F.col("rare.ids").alias("ids"))
    return both.mapInArrow(finished, schema) if then else both.mapInArrow(filled, f"doc_id {kind}, ids binary")


def decode_ids(ids: np.ndarray, pieces: list[str]) -> str:
    """One document's text; the tokenizer has no decoder, so pieces stand apart."""
    return " ".join([pieces[i] for i in ids.tolist()])


def joined_pieces(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Each document's pieces, one blank between: its ids joined with the rows of the piece table."""
    told = Ids.from_arrow(ids)
    ends = np.concatenate([[0], np.cumsum(told.count)])
    rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.take(pa.array(told.flat)))
    return pa.compute.binary_join(rows, pa.scalar(" ", pa.large_string()))


def _id_chunks(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of ids."""
    size = np.cumsum(pa.compute.binary_length(batch.column("ids")).to_numpy().astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of the rows of ``encode_documents``, special ids included."""
    path = path or default_path()

    def run(batches):
        pieces = pa.array(bpe(path).pieces, pa.large_string())
        for batch in batches:
            for b in _id_chunks(batch):
                yield pa.RecordBatch.from_arrays([b.column(0), joined_pieces(b.column(1), pieces).cast(pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()

    def sha256(texts: pa.Array) -> list[str]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
        data = memoryview(texts.buffers()[2] or b"")
        return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]

    def digests(batches):
        b = bpe(path)
        pieces, numerals = pa.array(b.pieces, pa.large_string()), pa.array([str(i) for i in range(len(b.pieces))], pa.large_string())
        for batch in batches:
            for c in _id_chunks(batch):
                ids = c.column("ids")
                rows = [c.column("doc_id"), pa.array(Ids.from_arrow(ids).count), pa.array(sha256(joined_pieces(ids, numerals))), pa.array(sha256(joined_pieces(ids, pieces)))]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, path, then=digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
