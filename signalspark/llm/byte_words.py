"""Words of whole Arrow columns of text, found and looked up in bulk with numpy.

A word is a run of letters, digits and bytes beyond ASCII, with A-Z lower-cased: as every
separator is an ASCII byte, words are cut on the UTF-8 bytes of a column at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: Words of so many bytes or fewer are held in two 64-bit lanes, which no two words share.
SHORT = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Words:
    """Words of a column in order: bytes body[start:stop] and the row of each."""

    body: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    rows: np.ndarray
    n_rows: int

    def lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, short): the bytes of each word in two numbers, zero-filled; `short`
        tells the words that they hold whole.  No word has a zero byte."""
        size = self.stops - self.starts
        eight = np.ndarray(len(self.body) - 7, "<u8", self.body, strides=(1,))
        first = eight[self.starts] & _MASKS[np.minimum(size, 8)]
        second = eight[np.where(size > 8, self.starts + 8, 0)] & _MASKS[np.clip(size - 8, 0, 8)]
        return first, second, size <= SHORT

    def word(self, k: int) -> bytes:
        return self.body[self.starts[k] : self.stops[k]].tobytes()


def byte_words(column: pa.Array) -> Words:
    """Words of a string column; a null row has none."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return Words(np.zeros(SHORT, np.uint8), *[np.zeros(0, np.int64)] * 3, n)
    edges = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    size = int(edges[-1] - edges[0])
    body = np.zeros(size + SHORT, np.uint8)
    body[:size] = _LOWER[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]]
    edges -= edges[0]
    inside = _IN_WORD[body[: size + 1]]  # the last one is a zero byte
    fresh, last = inside[:size].copy(), inside[:size].copy()
    fresh[1:] &= ~inside[: size - 1]
    last &= ~inside[1:]
    # A word ends with its row.
    cuts = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < size)]
    fresh[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(fresh)
    return Words(body, starts, np.flatnonzero(last) + 1, np.searchsorted(edges, starts, side="right") - 1, n)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two lanes."""
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Lookup:
    """Distinct keys of two lanes with the numbers 0, 1, ... in a hash table of linear probing."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first.astype(np.uint64), second.astype(np.uint64)
        self.mask = np.uint64((1 << max(4, (4 * len(first)).bit_length())) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(first), dtype=np.int32), mixed(self.first, self.second)
        while len(left):
            slot = at[left] & self.mask
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several for one slot the last one stays
            left = left[self.table[slot] != left]
            at[left] += np.uint64(1)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for others."""
        out, left, at = np.full(len(first), -1, np.int32), np.arange(len(first)), mixed(first, second)
        while len(left):
            got = self.table[at[left] & self.mask]
            same = (got >= 0) & (self.first[got] == first[left]) & (self.second[got] == second[left]) if len(self.first) else np.zeros(len(left), bool)
            out[left[same]] = got[same]
            left = left[(got >= 0) & ~same]
            at[left] += np.uint64(1)
        return out


class Vocabulary:
    """Words with the numbers 0, 1, ... in the given order, looked up exactly."""

    def __init__(self, words: list[bytes]):
        column = byte_words(pa.array([w.decode() for w in words], pa.string()))
        first, second, short = column.lanes()
        self.numbers = np.flatnonzero(short).astype(np.int32)
        self.short = Lookup(first[short], second[short])
        self.long = {column.word(k): k for k in np.flatnonzero(~short).tolist()}
        self.size = len(words)

    def find(self, words: Words) -> np.ndarray:
        first, second, short = words.lanes()
        place = self.short.find(first, second)
        out = np.where(short & (place >= 0), self.numbers[place] if len(self.numbers) else -1, -1).astype(np.int32)
        for k in np.flatnonzero(~short).tolist() if self.long else ():
            out[k] = self.long.get(words.word(k), -1)
        return out
