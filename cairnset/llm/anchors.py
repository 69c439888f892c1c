"""Content-defined anchors: positions that equal strings of `length` bytes choose alike."""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(77).integers(0, 2**64, 256, np.uint64)
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(78).integers(0, 2**63, 8)]
#: Bytes hashed at a time: positions in a piece fit 16 bits, and the arrays stay in a CPU's cache.
PIECE = 1 << 15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes (k a power of two), by doubling."""
    h, n, step = _TABLE[data], 1, 0
    while n < k:
        a = h[: len(h) - n] * _ODD[step]
        a ^= a >> np.uint64(29)
        a += h[n:]
        h = a
        n, step = n * 2, step + 1
    h *= _ODD[7]
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[: len(x) - n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): in each run of `length` bytes of one text, the first of its k-byte runs with the least hash.

    data: the bytes of several texts, which stand one after another and end at `ends`.
    """
    h = gram_hashes(data, k) if len(data) >= length else np.zeros(0, np.uint64)
    inside = np.ones(max(0, len(data) - length + 1), bool)  # runs that lie in one text
    if len(inside):
        cross = (ends[:, None] - np.arange(1, length)).ravel()
        inside[cross[(cross >= 0) & (cross < len(inside))]] = False
    w, found = length - k + 1, []
    for at in range(0, len(inside), PIECE):
        part = h[at : at + PIECE + w - 1]
        # the least of (hash, position) by one sliding minimum
        packed = (part & ~np.uint64(0xFFFF)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(packed, w)[inside[at : at + PIECE]]
        if len(least):
            first = (least & np.uint64(0xFFFF)).astype(np.int64)
            found.append(first[np.flatnonzero(np.diff(first, prepend=-1))] + at)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    positions = np.unique(np.concatenate(found))
    return positions, h[positions]
