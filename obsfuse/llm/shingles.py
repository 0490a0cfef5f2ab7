"""Word shingles as sorted 64-bit hashes, computed on whole slices of bytes at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from obsfuse.llm.store import mixed, slices

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.int64).view(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the concatenated rows, and the number of words before each row."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by differences of a running polynomial sum."""
    size = 1 << max(12, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, ascending; rows are taken in slices."""
    for a, b in slices(offsets):
        part = _LOWER[data[offsets[a] : offsets[b]]]
        at = offsets[a : b + 1] - offsets[a]
        starts, ends, before = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        n = len(words)
        if n >= width:
            joint = np.full(n - width + 1, width, np.uint64)
            for k in range(width):
                joint += words[k : n - width + 1 + k] * _PLACE[k]
            joint = mixed(joint)
        for lo, hi in zip(before[:-1], before[1:], strict=True):
            count = hi - lo
            if count >= width:
                yield np.unique(joint[lo : hi - width + 1])
            elif count:
                short = np.uint64(count) + (words[lo:hi] * _PLACE[:count]).sum(dtype=np.uint64)
                yield mixed(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
