"""Shingle sets of whole Arrow columns in numpy: no Python object per word.

A word's hash is a polynomial in its bytes, each replaced by a random 64-bit number (A-Z and a-z by the same),
modulo 2^64: the difference of two prefix sums, times the inverse power of where the word begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tideline.llm.common import _STEPS, mix, odd_constants

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = odd_constants(41, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = int(odd_constants(42, 1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a block ends at white space, so one longer word is a block of its own.
BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_POWERS = {base: _powers(base, BLOCK) for base in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    return _POWERS[base][:n] if n <= BLOCK else _powers(base, n)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order, and where each row's words begin (one more at the end)."""
    raw = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    space = _SPACE[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a row's end is a word's end
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, at = [], 0
    while at < len(starts):
        begin = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        out.append(_hashed(data[begin : ends[stop - 1]], starts[at:stop] - begin, ends[at:stop] - begin))
        at = stop
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every row's runs of ``width`` words; with fewer words the whole sequence is one."""
    words, bounds = words_of(column)
    words = mix(words)
    runs = np.full(max(0, len(words) - width + 1), width, dtype=np.uint64)
    for i in range(width if len(runs) else 0):
        runs += words[i : len(runs) + i] * _STEPS[i % 64]
    runs = mix(runs)
    out = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        k = end - begin
        if k >= width:
            found = np.sort(runs[begin : end - width + 1])
            new = np.empty(len(found), dtype=bool)
            new[0] = True
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        else:
            total = np.full(min(k, 1), k, dtype=np.uint64)
            for i in range(k):
                total += words[begin + i : begin + i + 1] * _STEPS[i % 64]
            out.append(mix(total))
    return out
