"""Pair merges of a byte-level BPE vocabulary, applied to many words at once in numpy.

Every word keeps the rank of each of its neighbouring pairs. A round takes the
lowest rank of every word, the leftmost of equals, and merges that pair; only
the two pairs around it change. This is the tokenizer's own order, word by word.
"""

from __future__ import annotations

import json

import numpy as np

U32, U64 = np.uint32, np.uint64
#: Words of a round, and bytes of the longest word that rounds pay for.
WORDS, LONGEST = 32768, 64
NONE, NO_PAIR, OUTSIDE = U64(0xFFFFFFFFFFFFFFFF), np.iinfo(np.int64).max, 0xFFFF
SLOTS = 17


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], U32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], U32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], U32)
        code = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], U32)
        self.table = np.full(1 << SLOTS, NONE, U64)  # pair in the upper half, rank in the lower
        entry, slot = code.astype(U64) << U64(32) | np.arange(len(code), dtype=U64), self._slot(code)
        while len(entry):  # open addressing; of those that want one free slot the first in order stays
            free = self.table[slot] == NONE
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.table[slot[first]] = entry[first]
            left = np.ones(len(entry), bool)
            left[first] = False
            entry, slot = entry[left], (slot[left] + 1) & (len(self.table) - 1)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * U32(0x9E3779B1)) >> U32(32 - SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_PAIR where the vocabulary has none."""
        code = left << U32(16) | right
        slot = self._slot(code)
        entry = self.table[slot]
        own = (entry >> U64(32)).astype(U32) == code
        rank = np.where(own & (entry != NONE), (entry & U64(0xFFFFFFFF)).astype(np.int64), NO_PAIR)
        todo = np.flatnonzero(~own & (entry != NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            entry = self.table[slot[todo]]
            own = ((entry >> U64(32)).astype(U32) == code[todo]) & (entry != NONE)
            rank[todo[own]] = (entry[own] & U64(0xFFFFFFFF)).astype(np.int64)
            todo = todo[~own & (entry != NONE)]
        return rank

    def encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words as 16-bit numbers, ids of each word) of words of ``size`` bytes, none empty."""
        ids, counts = np.zeros(0, np.uint16), np.zeros(len(size), np.int64)
        if not len(size):
            return ids, counts
        end = np.cumsum(size)
        order = np.argsort(size, kind="stable")  # words of like length take as many rounds
        parts = []
        for at in range(0, len(order), WORDS):
            k = order[at : at + WORDS]
            n = size[k]
            spot = np.repeat(end[k] - np.cumsum(n), n) + np.arange(n.sum())
            got, counts[k] = self._rounds(data[spot], n)
            parts.append(got)
        flat = np.concatenate(parts)
        begin = np.empty(len(size), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        spot = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))
        return flat[spot], counts

    def _rounds(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, end = len(data), np.cumsum(size)
        start = end - size
        token = np.empty(n + 1, U32)
        token[:n], token[n] = self.inner[data], OUTSIDE
        token[end - 1] = self.last[data[end - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[end - 1], after[n], before[start], before[n] = n, n, n, n
        pair = np.full(n + 1, NO_PAIR)  # rank of a place and the next, above the place

        def renew(at: np.ndarray) -> None:
            rank = self.ranks(token[at], token[after[at]])
            pair[at] = np.where(rank == NO_PAIR, NO_PAIR, rank << 32 | at)

        inner = np.ones(n, bool)
        inner[end - 1] = False
        renew(np.flatnonzero(inner))
        alive = np.ones(n + 1, bool)
        while True:
            best = np.minimum.reduceat(pair[:n], start)
            best = best[best != NO_PAIR]
            if not len(best):
                break
            p = best & 0xFFFFFFFF
            token[p] = self.merged[best >> 32]
            gone = after[p]
            alive[gone], pair[gone] = False, NO_PAIR
            after[p] = after[gone]
            before[after[p]] = p
            renew(np.concatenate([p, before[p]]))
            pair[n] = NO_PAIR
        return token[:n][alive[:n]].astype(np.uint16), np.add.reduceat(alive[:n], start, dtype=np.int64)
