"""Flat numpy views of Arrow text batches.

Tasks of this package see a batch of texts as one UTF-8 byte array plus row
offsets.  A null text has no bytes.  Batches are worked through in pieces of a
bounded number of bytes, so memory follows the longest single text, not the
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; nulls become empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if large else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]]
    return raw, off - off[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[i, j)`` holding at most ``most`` bytes, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, j, bytes, offsets)`` for each bounded piece of a batch's text column."""
    raw, off = text_bytes(batch.column(column))
    for i, j in pieces(off, most):
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each (s, n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each byte (or element) of flat data with these offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


#: 64-bit odd multipliers for byte and word hashes, and the byte base's inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** [0, n)`` modulo 2**64, kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span ``[start, end)``: a polynomial
    from prefix sums, moved to a common origin, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mixed_bytes()[raw] * powers(BASE, len(raw)), out=prefix[1:])
    poly = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(raw) + 1)[starts]
    return mix(poly + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_BYTES: list[np.ndarray] = []


def mixed_bytes() -> np.ndarray:
    """A fixed random 64-bit value for each byte value."""
    if not _BYTES:
        _BYTES.append(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return _BYTES[0]


#: The white space of the word contracts: space and the controls 9 to 13.
def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z folded to a-z and all others unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, row offsets)`` of the maximal runs of non-space bytes;
    a run never crosses a row border."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space_table()[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = solid[rows]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    borders = rows[1:] - 1
    last[borders] = solid[borders]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
