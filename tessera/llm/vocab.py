"""Words of a text batch as one dictionary and flat integer codes.

A dictionary holds the words themselves, so equal codes are equal words.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from tessera.llm.flat import lower_table


def byte_class(listed: Iterable[int]) -> np.ndarray:
    """Table of 256 flags, true for the listed bytes."""
    table = np.zeros(256, bool)
    table[list(listed)] = True
    return table


def encode(raw: np.ndarray, off: np.ndarray, solid: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(words, codes, starts)``: the distinct words (maximal runs of bytes with
    ``solid[byte]``, A-Z lowered, never crossing a row border), each word
    occurrence's place in them, and its first byte."""
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = solid[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = off[:-1][np.diff(off) > 0]
    first[rows] = inside[rows]
    last[rows[1:] - 1] = inside[rows[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    joined = lower_table()[raw[inside]]
    ends = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(joined)])
    got = flat.dictionary_encode()
    return got.dictionary.cast(pa.string()), got.indices.to_numpy().astype(np.int64), starts


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of consecutive pieces of ``values`` with these sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def packed(values: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """Binary array of consecutive pieces of ``values`` with these sizes (default:
    one piece); ``unpacked`` reads a piece again."""
    sizes = np.array([len(values)]) if sizes is None else sizes
    ends = np.concatenate([[0], np.cumsum(sizes) * values.itemsize]).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), data])


def unpacked(column: pa.Array | pa.ChunkedArray, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)
