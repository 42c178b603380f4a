"""Words of Arrow text columns as 64-bit hashes, byte-wise in numpy.

A word's hash is the sum over its bytes of a random number per byte value times a power of an odd base, mixed at the end;
running sums give it for all words of a batch at once. UTF-8 never has a separator's byte inside a character.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes whose running sums are in memory at once, but for a longer word.
SLICE = 1 << 17
BASE, FINAL = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)
#: A number for each byte value; A-Z have those of a-z.
VALUES = np.random.default_rng(11).integers(1, (1 << 64) - 1, 256, np.uint64)
VALUES[65:91] = VALUES[97:123]
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def trimmed() -> None:
    """Gives freed memory back, since a Python worker stays after its task, beside the work of others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base % (1 << 64), np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the lower-cased words between ASCII white space; row i has hashes[offsets[i]:offsets[i + 1]], a null none."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~WHITE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    out, i = np.empty(len(first), np.uint64), 0
    up, down = powers(BASE, SLICE), powers(pow(BASE, -1, 1 << 64), SLICE)
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + SLICE, side="right")))
        s, e = first[i], last[j - 1]
        if e - s > len(up):
            up, down = powers(BASE, e - s), powers(pow(BASE, -1, 1 << 64), e - s)
        sums = np.zeros(e - s + 1, np.uint64)
        np.cumsum(VALUES[b[s:e]] * up[: e - s], out=sums[1:])
        out[i:j] = (sums[last[i:j] - s] - sums[first[i:j] - s]) * down[first[i:j] - s]
        i = j
    out ^= out >> np.uint64(32)
    out *= FINAL
    return out ^ (out >> np.uint64(29)), np.searchsorted(first, at)
