"""Vectorised word, line and n-gram work on the UTF-8 bytes of Arrow string columns.

A `Block` is a run of whole texts laid end to end in one byte array. Words are maximal runs of bytes
outside space, tab, newline, vertical tab, form feed and carriage return; UTF-8 continuation bytes never
fall in that set, so words on bytes are words on characters. Hashes are 64-bit: two different strings
share one with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of its inverse)."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(1 << max(20, int(n).bit_length()), INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # n + 1

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def prefix_hash(self, table: np.ndarray = SAME) -> np.ndarray:
        """Running polynomial sums; `span_hash` reads any span's hash from them in constant time."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        values = table[self.data].astype(np.uint64)
        values += np.uint64(1)
        values *= powers(len(self.data))
        np.cumsum(values, out=sums[1:])
        return sums

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document index of every word."""
        solid = ~SPACE[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(solid), bool)
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return starts, ends, self.owner(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every newline-separated line (the newline is outside)."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]], feeds + 1)
        edge = np.zeros(len(self.data) + 2, bool)
        edge[feeds + 1] = True
        edge[self.offsets] = False
        starts = starts[(starts < len(self.data)) & (edge[starts] | np.isin(starts, self.offsets[:-1]))]
        stops = np.append(feeds, len(self.data))
        ends = np.minimum(stops[np.searchsorted(stops, starts)], self.offsets[self.owner(starts) + 1])
        return starts, ends

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a byte-level array for each document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, independent of where it stands."""
    inverse = powers(len(sums), inverse=True)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * STEP)


def ngram_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values (length len(values) - n + 1)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    m = len(values) - n + 1
    out = values[:m].copy()
    for i in range(1, n):
        out *= STEP
        out += values[i : i + m]
    return mix(out)


def binary_column(column) -> pa.Array:
    """Strings (null: empty) as one Arrow binary array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def blocks(column, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about block_bytes; a longer text is a block of its own."""
    column = binary_column(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs at least twice."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, a place of each, and for every key which of them it is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[first], order[first], which


def packed(column: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(column).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)
