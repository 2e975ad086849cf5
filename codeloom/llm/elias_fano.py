"""Elias-Fano lists: sorted numbers in about ``2 + log2(universe / n)`` bits each, with any member read directly.

The low bits of each number stand in a packed array.  The high bits stand in a bit vector in which
number ``k`` sets bit ``high + k``, and every 512 bits the ones before are counted, so that
``select`` reads one such block.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<qqB")
_BLOCK = 512


def encode(values: np.ndarray, universe: int) -> bytes:
    """The list of ``values``, which are sorted and lie in 0 to ``universe``."""
    n = len(values)
    width = max(0, (universe // n).bit_length() - 1) if n else 0
    values = np.asarray(values, dtype=np.int64)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    high = np.zeros(-(-(n + (universe >> width) + 1) // _BLOCK) * _BLOCK, dtype=np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    ones = high.reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<i8")
    return b"".join([_HEAD.pack(n, universe, width), before.tobytes(), np.packbits(high, bitorder="little").tobytes(), np.packbits(low, bitorder="little").tobytes()])


def size(data: bytes) -> int:
    """How many numbers the list has."""
    return _HEAD.unpack_from(data)[0]


def select(data: bytes, k: int) -> int:
    """Number ``k`` of the list, from 0."""
    n, universe, width = _HEAD.unpack_from(data)
    if not 0 <= k < n:
        raise IndexError(k)
    blocks = -(-(n + (universe >> width) + 1) // _BLOCK)
    before = np.frombuffer(data, dtype="<i8", count=blocks, offset=_HEAD.size)
    block = int(np.searchsorted(before, k, side="right")) - 1
    at = _HEAD.size + 8 * blocks
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=_BLOCK // 8, offset=at + block * (_BLOCK // 8)), bitorder="little")
    high = block * _BLOCK + int(np.flatnonzero(bits)[k - int(before[block])]) - k
    if not width:
        return high
    first = k * width
    lo, hi = first // 8, (first + width + 7) // 8
    at += blocks * (_BLOCK // 8)
    part = int.from_bytes(data[at + lo : at + hi], "little") >> (first - 8 * lo)
    return high << width | part & ((1 << width) - 1)
