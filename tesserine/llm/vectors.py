"""Words and windows of many texts at once, as numpy arrays; and columns packed for a shuffle."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
#: Bytes of text that a kernel handles at once; a longer text is handled alone.
CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library: it keeps its own counsel
    _trim = None


def release() -> None:
    """Give freed memory back to the system: a worker that sits idle must not hold a kernel's peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _bytes_table(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(lane * 7919 + 1))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the lane's odd base, or of its inverse modulo 2 ** 64."""
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        base = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)[lane]
        base = pow(base, -1, 1 << 64) if inverse else base
        n = max(n, CHUNK + 4096)
        have = np.empty(n, U)
        have[0] = 1
        done = 1
        while done < n:  # doubling: powers k..2k are powers 0..k times base ** k
            step = min(done, n - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        _powers[lane, inverse] = have
    return have


def _sums(values: np.ndarray, lane: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(lane, len(values))[: len(values)], out=out[1:])
    return out


def _between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """The hash of each range: its polynomial, moved to the origin."""
    return mix((sums[end] - sums[start]) * _power(lane, len(sums), inverse=True)[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


class Words:
    """The words of several texts: ``start`` and ``end`` in the joined buffer, ``first`` word of each text."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[self.buffer]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=offsets[1:])
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(self.start)) - self.first[self.text]

    @functools.cached_property
    def _word_sums(self) -> dict[int, np.ndarray]:
        return {}

    def word_hash(self, lane: int = 0) -> np.ndarray:
        """Of each word; a word's hash doesn't depend on its place, so a long buffer is taken in slices."""
        out, lo = np.empty(len(self.start), U), 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + 4 * CHUNK, side="right")))
            a, b = self.start[lo], self.end[hi - 1]
            out[lo:hi] = _between(_sums(_bytes_table(lane)[self.buffer[a:b]], lane), self.start[lo:hi] - a, self.end[lo:hi] - a, lane)
            lo = hi
        return out

    def windows(self, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words inside one text."""
        if lane not in self._word_sums:
            self._word_sums[lane] = _sums(self.word_hash(lane), lane)
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, self.hash_at(at, k, lane)

    def hash_at(self, at: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
        if lane not in self._word_sums:
            self._word_sums[lane] = _sums(self.word_hash(lane), lane)
        return _between(self._word_sums[lane], at, at + k, lane)


def byte_windows(buffer: np.ndarray, at: np.ndarray, k: int | np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of the k bytes at each place."""
    return _between(_sums(_bytes_table(lane)[buffer], lane), at, at + k, lane)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes; none is empty."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))
    release()


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(values: np.ndarray) -> bytes:
    return _PACK.compress(values.tobytes())


def unsqueezed(blob: bytes) -> bytes:
    return _UNPACK.decompress(blob)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed byte planes; signed ones as differences first."""
    out = [bytes((len(columns),)), len(columns[0]).to_bytes(4, "little")]
    planes = []
    for c in columns:
        out.append(c.dtype.str[1:].encode())
        if c.dtype.kind == "i":
            c = np.diff(c, prepend=c.dtype.type(0))
        planes.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T).tobytes())
    return b"".join(out) + _PACK.compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    k, n = blob[0], int.from_bytes(blob[1:5], "little")
    kinds = [np.dtype(blob[5 + 2 * i : 7 + 2 * i].decode()) for i in range(k)]
    raw = np.frombuffer(_UNPACK.decompress(blob[5 + 2 * k :]), np.uint8)
    out, at = [], 0
    for kind in kinds:
        size = n * kind.itemsize
        c = np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, n).T).view(kind).ravel()
        out.append(np.cumsum(c, dtype=kind) if kind.kind == "i" else c)
        at += size
    return out


def joined(blobs, empty: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of several packs, one after the other."""
    release()
    parts = [unpack(bytes(b)) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in empty]


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A pack of the rows of each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
        rows = order[lo:hi]
        yield int(b[lo]), pack(*(c[rows] for c in columns))


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every range, one range after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the length at the end."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for k in sorted_keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
