"""Word and shingle hashing over whole Arrow batches.

Helpers for tasks: they take the byte buffer and the offsets of an Arrow
string column and work on all texts of a slice at once with numpy.  Words are
runs of bytes other than the space and \\x09-\\x0D, A-Z lower-cased; all those
separators are ASCII, so UTF-8 texts can be cut as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; bounds a task's memory, not what it reads.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


_POSITIONS = 64
with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, _POSITIONS * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    _ODD = mix(np.arange(1, 65, dtype=U)) | U(1)


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer text has a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word, and the number of words before each row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = ~space[heads]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each row (one more than rows)."""
    starts, before = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, U), before
    n = len(data)
    at = np.zeros(n, np.int64)
    at[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    with np.errstate(over="ignore"):
        byte = _LOWER[data] if lower else data
        value = _TABLE[np.minimum(at, _POSITIONS - 1) * 256 + byte]
        if len(far := np.flatnonzero(at >= _POSITIONS)):
            value[far] = mix((at[far].astype(U) * U(256) + byte[far] + U(1)) * U(0x9E3779B97F4A7C15))
        value[_SPACE[data]] = 0
        return mix(np.add.reduceat(value, starts)), before


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and their offsets.

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    rows = len(offsets) - 1
    hashes, before = word_hashes(data, offsets)
    counts = np.diff(before)
    with np.errstate(over="ignore"):
        total = max(0, len(hashes) - words + 1)
        rolled = np.zeros(total, U)
        for j in range(words):
            rolled += hashes[j : j + total] * _ODD[j]
        rolled = mix(rolled)
        sets = []
        for i in range(rows):
            c = counts[i]
            if c >= words:
                sets.append(np.sort(rolled[before[i] : before[i + 1] - words + 1]))
            elif c:
                sets.append(mix((hashes[before[i] : before[i + 1]] * _ODD[:c]).sum(keepdims=True, dtype=U) + U(c)))
            else:
                sets.append(np.zeros(0, U))
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    inner = bounds[:-1][bounds[:-1] < len(flat)]
    keep[inner] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept_before[bounds]


def per_row(column: pa.Array, words: int = 5, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, shingle hashes, their offsets)."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets, size):
        flat, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        yield i, flat, bounds
