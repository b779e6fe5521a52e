"""Words and their hashes for whole Arrow batches of texts, in numpy, without a Python loop per word.

Hashes have 64 bits and are the same on every machine. Null texts count as empty here; callers that
treat them otherwise look at the validity themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer text forms a piece of its own.
PIECE_BYTES = 1 << 20
BASE = U(0x9E3779B97F4A7C15 | 1)


def _byte_values() -> np.ndarray:
    """A mixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = _byte_values()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at white space, and of words of ASCII letters, digits and other scripts.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 4096)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            row = np.full(size, base, U)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=U)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Piece:
    """Some consecutive texts: their bytes, and where each text starts and ends in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of bytes that `table` allows."""
        inside = table[self.data]
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        edges = self.offsets[:-1]
        before[edges[edges < len(inside)]] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        edges = self.offsets[1:]
        after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets[1:], starts, side="right")

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
        """The hash of each span of bytes; with `fold`, ASCII capitals count as small letters."""
        up, down = powers(len(self.data) + 1)
        values = BYTE_VALUES[LOWER[self.data] if fold else self.data]
        total = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])

    def bounds(self, owner: np.ndarray) -> np.ndarray:
        """Where the spans of each text begin and end in a list ordered by text."""
        return np.searchsorted(owner, np.arange(len(self) + 1))


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column of texts into pieces of about `limit` bytes, never inside a text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        part = offsets[first : last + 1]
        yield Piece(first, data[part[0] : part[-1]], part - part[0])
        first = last


#: Multipliers of the places in a shingle.
PLACES = mix(np.arange(101, 165, dtype=U)) | U(1)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted set of hashed `size`-word shingles of each text; a shorter text is one shingle."""
    out = []
    if len(words) >= size:
        rolled = words[: len(words) - size + 1] * PLACES[0]
        for k in range(1, size):
            rolled = rolled + words[k : len(words) - size + 1 + k] * PLACES[k]
        rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            got = np.sort(rolled[a : b - size + 1])
            if len(got) > 1:
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
            out.append(got)
        elif b > a:
            part = words[a:b]
            short = (part * PLACES[: b - a]).sum(dtype=U) + U(b - a)
            out.append(mix(np.array([short], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def word_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle set) of each text, words ending at ASCII white space."""
    for piece in pieces(column):
        starts, ends, owner = piece.spans(SOLID)
        words = piece.hashes(starts, ends)
        for k, got in enumerate(shingles(words, piece.bounds(owner), size)):
            yield piece.first + k, got


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Join small output batches into batches of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
