"""Words of whole Arrow string batches as offset arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]+` and, once lower-cased, of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; bytes of code points above ASCII belong to both.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

SLICE_BYTES = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text up to which words are hashed by prefix sums; longer texts are hashed word by word, with the same result.
POWERS = 1 << 21
LONG_WORD = 256


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _PRIME from the first on, and the inverses, modulo 2 ** 64, of its powers from the zeroth on."""
    inverse = np.full(POWERS, pow(int(_PRIME), -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    return np.multiply.accumulate(np.full(POWERS, _PRIME)), np.multiply.accumulate(inverse)


@dataclass
class Words:
    """Words of a slice of documents: word i is low[start[i]:end[i]]; document d has words first[d]:first[d + 1]."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process.

        Powers modulo 2 ** 64 collide on certain words of 1,024 characters and more, whatever the prime, so
        words of over LONG_WORD bytes have a BLAKE2 hash.
        """
        out = self._sums()
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.low[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def _sums(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        if len(self.low) <= POWERS:
            # Prefix sums of byte x power; a word's own sum is the difference of two, divided by the power where it starts.
            power, inverse = _powers()
            sums = np.zeros(len(self.low) + 1, dtype=np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power[: len(self.low)], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + size.astype(np.uint64))
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        power = np.multiply.accumulate(np.full(int(size.max()), _PRIME, dtype=np.uint64))
        values = (self.low[np.repeat(self.start, size) + inside].astype(np.uint64) + np.uint64(1)) * power[inside]
        return mix(np.add.reduceat(values, at) + size.astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place where k words follow one another; documents are not told apart."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * _PRIME + h[i : i + n])
    return out


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Row ranges of about `most` bytes of text each (one row at least), nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(column):
        base = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, column.slice(lo, hi - lo)
        lo = hi


def split_words(column: pa.Array, table: np.ndarray) -> Words:
    """column: a null-free large_string array, as slices() yields."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    base = int(offsets[0])
    raw = np.frombuffer(data, dtype=np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - base
    low = LOWER[raw]
    inside = table[low]
    if not len(low):
        none = np.zeros(0, dtype=np.int64)
        return Words(low, none, none, np.zeros(len(column) + 1, dtype=np.int64))
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(low, start, end, np.searchsorted(start, offsets))
