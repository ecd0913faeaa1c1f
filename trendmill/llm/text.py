"""Vectorised text helpers that run inside Arrow tasks.

A text column is handled as its UTF-8 bytes: separators of words are single
ASCII bytes, so word borders, hashes and shingles of a whole batch come from a
few numpy passes. Hashes are 64-bit and equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(1 << bits, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@dataclass
class Chunk:
    """Consecutive texts: rows [first, first + len(offsets) - 1) of a column."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a chunk: byte spans, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    of_row: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``limit`` bytes; null is empty.

    A text longer than the limit is a chunk of its own and is never cut.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        own = offsets[first : last + 1]
        yield Chunk(first, data[own[0] : own[-1]], own - own[0])
        first = last


def words(chunk: Chunk) -> Words:
    """Words: runs of bytes other than 0x20 and 0x09-0x0D, never across texts."""
    inside = ~SEPARATOR[chunk.data]
    size = len(inside)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    border = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < size)]
    opens[border] = inside[border]
    closes[border - 1] = inside[border - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, chunk.offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte span, from a prefix sum of weighted bytes."""
    bits = max(21, int(len(data)).bit_length())
    power, inverse = _powers(bits)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring hashes, order kept."""
    size = len(hashes) - width + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:size] + U(width)
    for k in range(1, width):
        out = mix(out * U(BASE) + hashes[k : k + size])
    return out


def shingle_sets(chunk: Chunk, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct ``width``-word shingles, as ascending hashes.

    A-Z are lower-cased. A text of fewer words has its whole sequence as its one
    shingle; a text without words has the empty set.
    """
    data = LOWER[chunk.data]
    found = words(chunk)
    hashes = span_hashes(data, found.start, found.end)
    full = fold(hashes, width)
    for a, b in zip(found.of_row[:-1].tolist(), found.of_row[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        else:
            yield fold(hashes[a:b], b - a) if b > a else full[:0]
