"""Vectorised word and shingle hashing straight from Arrow string buffers.

Words are maximal runs of bytes of a class, after A-Z is lower-cased; both
classes used here are closed under UTF-8 (every byte from 0x80 on belongs to a
word), so byte classes and character classes agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that belong to words: all but space and 0x09-0x0D; or digits, letters and 0x80 on.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] | _U(1)
_P = 0x9E3779B97F4A7C15
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 16, _P)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null is empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def words(texts: pa.Array, of: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first[i] = index of row i's first word, with a closing total, word starts, word ends) over all rows."""
    raw, offs = buffers(texts)
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offs), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = of[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offs)
    if len(starts) == 0:
        return np.zeros(0, _U), first, starts, ends
    length = ends - starts
    at = np.flatnonzero(inside)
    first_byte = np.cumsum(length) - length
    rank = np.arange(len(at)) - np.repeat(first_byte, length)
    value = _VALUE[raw[at]] * _POW[rank & 0xFFFF]
    if length.max() > 0xFFFF:
        value *= _powers(int(length.max() >> 16) + 1, pow(_P, 1 << 16, 1 << 64))[rank >> 16]
    return mix(np.add.reduceat(value, first_byte) ^ (length.astype(_U) * _STEP)), first, starts, ends


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, for the len(h) - k + 1 positions."""
    m = max(0, len(h) - k + 1)
    out = h[:m].copy()
    for i in range(1, k):
        out *= _STEP
        out += h[i : i + m]
    return mix(out ^ _U(k))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle of every row; a row of fewer words, but not none, is one shingle."""
    n = np.diff(first)
    full = runs(h, k)
    count = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    if len(row):
        start = np.repeat(first[:-1], count) + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        out = full[start]
    else:
        out = np.zeros(0, _U)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([runs(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short], dtype=_U)
        out, row = np.concatenate((out, whole)), np.concatenate((row, short))
    return out, row


def distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (value, row), ordered by row and value."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        keep = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
        value, row = value[keep], row[keep]
    return value, row
