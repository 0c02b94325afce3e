"""TIFF files in memory: walk image directories, decode strips and tiles, undo predictors.

Reads baseline files of 8-bit samples in either byte order, chunky or planar,
uncompressed or packed by PackBits, LZW or deflate, with horizontal
differencing or none. Writes the same, one directory per page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# Tags of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    pixels: np.ndarray  # height x width x samples


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 2:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends."""
    out: list[bytes] = []
    words: list[bytes] = []
    last = b""
    bits, have, at, width = 0, 0, 0, 9
    while True:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFFFF
            have += 8
            at += 1
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            words, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            word = words[code]
        elif code < len(words):
            word = words[code]
            words.append(last + word[:1])
        elif code == len(words):
            word = last + last[:1]
            words.append(word)
        else:
            raise ValueError("LZW code beyond its table")
        out.append(word)
        last = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1


def lzw_encode(data: bytes) -> bytes:
    out, bits, have, width = bytearray(), 0, 0, 9
    known: dict[bytes, int] = {bytes((i,)): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal bits, have
        bits = bits << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    free, word = 258, b""
    for b in data:
        longer = word + bytes((b,))
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = free
        free += 1
        if free >= (1 << width) and width < 12:
            width += 1
        if free == 4095:
            put(256)
            known = {bytes((i,)): i for i in range(256)}
            free, width = 258, 9
        word = bytes((b,))
    if word:
        put(known[word])
        free += 1
        if free >= (1 << width) and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def _decoded(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data)
    if kind == LZW:
        return lzw_decode(data)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {kind} is not one of this reader's")


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The tags of each image directory, following the chain from the header."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            here = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, here)
            if kind not in TYPES or kind == 2:
                continue
            form = f"{order}{count}{TYPES[kind]}"
            place = here + 8
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(form, data, place)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_pages(data: bytes) -> Iterator[Page]:
    for number, t in enumerate(directories(data)):
        width, height, samples = t[WIDTH][0], t[LENGTH][0], t.get(SAMPLES, (1,))[0]
        if any(b != 8 for b in t.get(BITS, (1,))):
            raise ValueError("samples are not of 8 bits")
        kind, predictor = t.get(COMPRESSION, (NONE,))[0], t.get(PREDICTOR, (1,))[0]
        planes = samples if t.get(PLANAR, (1,))[0] == 2 else 1
        deep = samples // planes
        if TILE_OFFSETS in t:
            w, h = t[TILE_WIDTH][0], t[TILE_LENGTH][0]
            offsets, counts = t[TILE_OFFSETS], t[TILE_COUNTS]
        else:
            w, h = width, min(t.get(ROWS_PER_STRIP, (height,))[0], height) or 1
            offsets, counts = t[STRIP_OFFSETS], t[STRIP_COUNTS]
        across, down = -(-width // w), -(-height // h)
        pixels = np.zeros((height, width, samples), np.uint8)
        for k, (o, c) in enumerate(zip(offsets, counts)):
            plane, rest = divmod(k, across * down)
            y, x = rest // across * h, rest % across * w
            rows = h if TILE_OFFSETS in t else min(h, height - y)
            raw = np.frombuffer(_decoded(kind, data[o : o + c]), np.uint8)[: rows * w * deep].reshape(rows, w, deep)
            if predictor == 2:
                raw = np.cumsum(raw, axis=1, dtype=np.uint8)
            part = raw[: height - y, : width - x]
            pixels[y : y + part.shape[0], x : x + part.shape[1], plane * deep : plane * deep + deep] = part
        yield Page(number, width, height, samples, kind, pixels)


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of the pages (height x width x samples), in strips of ``rows`` or tiles of (width, length)."""
    encode = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}[compression]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for pixels in pages:
        height, width, samples = pixels.shape
        blocks = []
        if tile:
            w, h = tile
            for y in range(0, height, h):
                for x in range(0, width, w):
                    block = np.zeros((h, w, samples), np.uint8)
                    part = pixels[y : y + h, x : x + w]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [pixels[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
            data = encode(np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_LENGTH, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [
            (STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)
        ]
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                place = struct.pack("<I", len(out))
                out += data + b"\0" * (len(data) % 2)
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        if len(out) % 2:
            out.append(0)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)
