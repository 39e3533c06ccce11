"""Vectorised building blocks over Arrow string buffers: hash tables, rolling hashes, ragged gathers.

Texts are never turned into Python strings here.  A batch is one UTF-8 byte buffer plus offsets, and every step is
a numpy pass over it, so the cost per byte is a handful of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class HashTable:
    """Open addressing from 64-bit keys to int32 values, looked up and filled a whole array at a time."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent.  Keys must be mixed and not 0."""
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != 0))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            at, want = slot[todo], keys[todo]
            found = self.keys[at]
            same = found == want
            out[todo[same]] = self.values[at[same]]
            todo = todo[~same & (found != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet; grows by doubling at half load."""
        while (self.size + len(keys)) * 2 > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            HashTable.__init__(self, self.bits + 1)
            self._fill(k, v)
        self._fill(keys, np.asarray(values, dtype=np.int32))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.size += len(keys)
        slot, todo = self.slots(keys), np.arange(len(keys))
        while todo.size:
            at = slot[todo]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]
            won = free & (self.keys[at] == keys[todo])
            self.values[at[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)


class Rolling:
    """Hashes of any slices of a symbol sequence from one prefix sum: sum of R[symbol] * BASE**position mod 2**64."""

    _powers = np.ones(1, dtype=U64)
    _inverse = np.ones(1, dtype=U64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers) <= n:
            m = 1 << max(16, int(n).bit_length())
            for name, base in (("_powers", BASE), ("_inverse", INVERSE)):
                p = np.full(m, U64(base))
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls._powers, cls._inverse

    def __init__(self, symbols: np.ndarray, randoms: np.ndarray):
        power, self.inverse = self.powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=U64)
        np.cumsum(randoms[symbols] * power[: len(symbols)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start]) | U64(1)


RANDOMS = mix(np.arange(1, 1025, dtype=U64) * U64(0xD1342543DE82EF95))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every slice, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text worked on at once; bounds the temporary arrays, which take up to some 200 times this.
UNIT = 1 << 18


def units(data: np.ndarray, offsets: np.ndarray, unit: int = UNIT) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `unit` bytes (a longer document is alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + unit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
