"""Jaccard join of the sets of one block by a tree of token bitmaps.

A node holds the OR of its members' bitmaps, the range of their sizes, the largest number of
tokens that share a bit with another one, and the component of its members if they have only
one. Two nodes are walked together: the pair is dropped when the size ranges cannot reach the
wanted similarity, when the common bits allow too small an overlap, or when all members of both
are known to be connected. What is left at the leaves is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Children of a node.
FAN = 8
#: Node pairs that are expanded at once; bounds the memory of the walk.
AT_ONCE = 4096


class Groups:
    """Union-find over the members of a block."""

    def __init__(self, labels: np.ndarray) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(len(self.up))), np.int64, len(self.up))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether intersection / union of two ascending arrays is num / den or more."""
    n, m = len(a), len(b)
    if not min(n, m) or (num + den) * min(n, m) < num * (n + m):
        return False
    return (num + den) * overlap(a, b) >= num * (n + m)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def bitmap_bits(n: int, per_token: int) -> int:
    """A power of two of at least ``per_token`` bits for each of ``n`` tokens, 256 at least."""
    return 1 << max(8, int(per_token * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words with a bit for each token; half the bits of it are its two halves ORed."""
    out = np.zeros(bits // 64, np.uint64)
    at = (tokens >> np.uint64(20)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def stacked(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of different length as one matrix, folded to the shortest."""
    width = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def _levels(bits: np.ndarray, size: np.ndarray, extra: np.ndarray, group: np.ndarray) -> list[tuple]:
    levels = [(bits, size, size, extra, group)]
    while len(levels[-1][0]) > 1:
        bits, low, high, extra, group = levels[-1]
        at = np.arange(0, len(bits), FAN)
        same = np.minimum.reduceat(group, at) == np.maximum.reduceat(group, at)
        levels.append(
            (
                np.bitwise_or.reduceat(bits, at, axis=0),
                np.minimum.reduceat(low, at),
                np.maximum.reduceat(high, at),
                np.maximum.reduceat(extra, at),
                np.where(same, group[at], -1),
            )
        )
    return levels


def _possible(level: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    bits, low, high, extra, group = level
    keep = (group[i] < 0) | (group[i] != group[j])
    keep &= (den * high[i] >= num * low[j]) & (den * high[j] >= num * low[i])
    at = np.flatnonzero(keep)
    common = np.bitwise_count(bits[i[at]] & bits[j[at]]).sum(axis=1, dtype=np.int64)
    bound = common + np.minimum(extra[i[at]], extra[j[at]])
    keep[at] = (num + den) * bound >= num * (low[i[at]] + low[j[at]])
    return keep


def walk(levels: list[tuple], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of member pairs ``i < j`` that no bound excludes."""
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = np.arange(FAN)
    while stack:
        depth, i, j = stack.pop()
        if len(i) > AT_ONCE:
            stack.append((depth, i[AT_ONCE:], j[AT_ONCE:]))
            i, j = i[:AT_ONCE], j[:AT_ONCE]
        keep = _possible(levels[depth], i, j, num, den)
        if depth == 0:
            keep &= i != j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if depth == 0:
            yield i, j
            continue
        n = len(levels[depth - 1][0])
        a = (i[:, None, None] * FAN + step[None, :, None]).repeat(FAN, axis=2).ravel()
        b = (j[:, None, None] * FAN + step[None, None, :]).repeat(FAN, axis=1).ravel()
        fits = (a < n) & (b < n) & (a <= b)
        stack.append((depth - 1, a[fits], b[fits]))


def tree_candidates(maps: list[np.ndarray], size: np.ndarray, labels: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with different labels that may reach the similarity by their bitmaps."""
    if len(size) < 2:
        return
    if len(size) <= FAN:  # one node holds all: its members are compared at once
        i, j = np.triu_indices(len(size), 1)
        fits = (labels[i] != labels[j]) & (den * size[i] >= num * size[j]) & (den * size[j] >= num * size[i])
        i, j = i[fits], j[fits]
        if len(i):
            bits = stacked(maps)
            extra = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            bound = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(extra[i], extra[j])
            fits = (num + den) * bound >= num * (size[i] + size[j])
            if fits.any():
                yield i[fits], j[fits]
        return
    order = np.lexsort((size, labels))
    bits = stacked([maps[k] for k in order])
    size = size[order]
    extra = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    groups = np.unique(labels[order], return_inverse=True)[1]
    for i, j in walk(_levels(bits, size, extra, groups), num, den):
        yield order[i], order[j]


def tree_links(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of positions that join components: after them, all sets of a similarity of num / den or
    more are connected. Members of one label count as connected beforehand.
    """
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2 or not size.max():
        return []
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], size))
    sets, size, labels = [sets[k] for k in order], size[order], labels[order]
    groups, found = Groups(labels), []

    def test(i: int, j: int) -> None:
        if groups.root(i) != groups.root(j) and similar(sets[i], sets[j], num, den):
            groups.join(i, j)
            found.append((int(order[i]), int(order[j])))

    bits = stacked([bitmap(s, bitmap_bits(len(s), 4)) for s in sets])
    extra = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for i in range(len(sets) - 1):  # neighbours in the order are the likeliest links
        test(i, i + 1)
    for i, j in walk(_levels(bits, size, extra, groups.roots()), num, den):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            test(a, b)
    return found
