"""Hierarchical index over 64-bit fingerprints in the order of the Gray code."""

from __future__ import annotations

import numpy as np

FAN = 16


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits as a signed integer, each set if it is set in over half of the hashes (their bytes, eight
    to a hash); zero if there are none."""
    n = len(hashes) // 8
    bits = np.zeros(64, np.int64)
    raw = hashes.reshape(n, 8)
    for i in range(0, n, 65_536):
        bits += np.unpackbits(raw[i : i + 65_536], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big", signed=True)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray code: the prefix parities of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over fingerprints (uint64), apart for each key. ``order`` is the Gray order
    within keys; level 0 has the fingerprints, the last level one node for each key."""

    def __init__(self, key: np.ndarray, fp: np.ndarray, fan: int = FAN):
        self.order = np.lexsort((gray_rank(fp), key))
        self.fp, key = fp[self.order], key[self.order]
        n = len(fp)
        first = np.ones(n, bool)
        first[1:] = key[1:] != key[:-1]
        owner = np.cumsum(first) - 1
        self.root = owner  # of each row; its root has the same place in the last level
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        ones, zeros, last, groups = self.fp, ~self.fp, np.arange(n), owner
        self.levels = []  # (pattern, mask, last row, first child, children)
        self.levels.append((self.fp, np.full(n, full), last, None, None))
        roots = int(owner[-1]) + 1 if n else 0
        while len(ones) > roots:
            at = np.arange(len(groups))
            start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            inside = at - np.repeat(start, np.diff(np.r_[start, len(groups)]))
            cut = np.flatnonzero(inside % fan == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            ends = np.r_[cut[1:], len(groups)]
            last, groups = last[ends - 1], groups[cut]
            self.levels.append((ones, ones | zeros, last, cut, ends - cut))

    def pairs(self, most: int, room: int = 1 << 17):
        """Arrays (i, j), i before j in ``order``, of rows of one key that differ in at most ``most``
        bits. A search is a query and a node; ``room`` of them are walked at a time, depth first, so
        that memory is bounded however many there are."""
        for lo in range(0, len(self.fp), room):
            q = np.arange(lo, min(lo + room, len(self.fp)))
            stack = [(len(self.levels) - 1, q, self.root[q], np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64))]
            while stack:
                level, q, node, acc, above = stack.pop()
                if len(q) > room:
                    half = len(q) // 2
                    stack += [(level, *(x[half:] for x in (q, node, acc, above))), (level, *(x[:half] for x in (q, node, acc, above)))]
                    continue
                pattern, mask, last, child, children = self.levels[level]
                new = mask[node]
                acc = acc + np.bitwise_count((self.fp[q] ^ pattern[node]) & new & ~above)
                keep = (acc <= most) & (last[node] > q)
                q, node, acc, above = q[keep], node[keep], acc[keep], new[keep]
                if not len(q):
                    continue
                if not level:
                    yield q, node
                    continue
                n = children[node]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                stack.append((level - 1, np.repeat(q, n), np.repeat(child[node], n) + step, np.repeat(acc, n), np.repeat(above, n)))
