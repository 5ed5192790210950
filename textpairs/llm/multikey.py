"""Multikey three-way quicksort of pointers in numpy: all open partitions are split at once.

Every partition shares its characters up to its depth.  In each round it takes a pivot character (the median of
its first, middle and last) and is split into smaller, equal and larger; the equal part goes one character deeper.  A
*character* is what ``key_at`` gives for a pointer and a depth: a word, or eight bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The integers ``start[i] .. start[i] + size[i] - 1`` of all i, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def three_way(ptr: np.ndarray, key_at: Callable, depth: int, least: int = 2, weight: np.ndarray | None = None, on_equal: Callable | None = None, end: int | None = None):
    """Sorts ``ptr`` in place by its first ``depth`` characters; gives (start, size) of the partitions equal so far.

    ``key_at(pointers, depths)`` gives uint64 characters.  A partition whose pointers weigh less than ``least`` in all
    (``weight`` by pointer, else 1 each) is abandoned: its pointers stay together, in no order.  ``on_equal(first
    pointer, characters, weight)`` hears of every equal partition that is not abandoned.  Behind the character ``end``
    nothing is compared.
    """
    lo, size, at = np.zeros(1, np.int64), np.array([len(ptr)]), np.zeros(1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if len(ptr) < (1 if weight is not None else least) or depth <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(lo):
        start = np.cumsum(size) - size
        idx, part = ranges(lo, size), np.repeat(np.arange(len(lo)), size)
        p = ptr[idx]
        k = key_at(p, at[part])
        a, b, c = k[start], k[start + size // 2], k[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        over = pivot[part]
        sides = (k < over, k == over, k > over)
        begin, parts = lo.copy(), []
        for side in sides:
            n = np.bincount(part[side], minlength=len(lo))
            mine = p[side]
            ptr[ranges(begin, n)] = mine
            total = n if weight is None else np.bincount(part[side], weight[mine], len(lo)).astype(np.int64)
            parts.append((begin.copy(), n, total))
            begin += n
        nxt = []
        for j, (b0, n, total) in enumerate(parts):
            keep = (total >= least) & (n > 0)
            deeper = at + (j == 1)
            if j == 1:
                if end is not None:
                    keep &= pivot != np.uint64(end)
                if on_equal is not None and keep.any():
                    on_equal(ptr[b0[keep]], deeper[keep], total[keep])
                full = keep & (deeper == depth)
                done.append((b0[full], n[full]))
                keep &= ~full
            if weight is None:
                keep &= n > 1
            nxt.append((b0[keep], n[keep], deeper[keep]))
        lo, size, at = (np.concatenate(x) for x in zip(*nxt))
    s, n = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(s)
    return s[order], n[order]
