"""Suffix arrays and common prefixes of one shard, in numpy."""

from __future__ import annotations

import numpy as np


def eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian number."""
    return np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))


def suffix_array(text: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first `depth` bytes at least.

    Larsson-Sadakane refinement: suffixes are first grouped by eight bytes; a group's
    rank is its last place in the order. Each round sorts only what is still tied, by
    the rank of the suffix that starts h later, and doubles h. Ties that remain at the
    end agree in depth bytes or more. Past the end stand zero bytes.
    """
    n = len(text)
    first = eights(text + bytes(8))[:n].byteswap()
    order = np.argsort(first, kind="stable")
    heads = np.r_[True, first[order][1:] != first[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def last_of(heads: np.ndarray) -> np.ndarray:
        ends = np.r_[np.flatnonzero(heads)[1:], len(heads)] - 1
        return ends[np.cumsum(heads) - 1]

    if n:
        rank[order] = last_of(heads)
    h = 8
    while h < depth and n:
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        key = rank[np.minimum(suffix + h, n)]
        group = rank[suffix]
        inner = np.lexsort((key, group))
        suffix, key, group = suffix[inner], key[inner], group[inner]
        order[at] = suffix
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        heads[at] = new
        # A group's rank becomes its last place; `at` holds whole groups.
        ends = np.r_[np.flatnonzero(new)[1:], len(new)] - 1
        rank[suffix] = at[ends[np.cumsum(new) - 1]]
        h *= 2
    return order, rank[:n]


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the order, bytes shared with the suffix before it, at most `most`.

    Kasai's bound: a suffix shares at least one byte less with its neighbour than the
    suffix that starts one byte earlier. Every eighth suffix is compared from the start;
    the others follow in seven steps, each from the bound of the step before. The bound
    needs an order by more bytes than were shared, so it is not used at `most`.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = eights(text + bytes(most + 16))
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    shared = np.zeros(n, np.int64)
    for step in range(8):
        at = np.arange(step, n, 8)
        known = shared[at - 1] if step else np.zeros(len(at), np.int64)
        length = np.where(known < most, np.maximum(known - 1, 0), 0)
        alive = np.flatnonzero((before[at] >= 0) & (length < most))
        length[before[at] < 0] = 0
        while len(alive):
            a, b = at[alive] + length[alive], before[at[alive]] + length[alive]
            differ = words[a] ^ words[b]
            equal = differ == 0
            low = differ & (~differ + np.uint64(1))
            # The lowest set bit tells the first byte that differs.
            same = np.where(equal, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            length[alive] += same
            alive = alive[equal & (length[alive] < most)]
        shared[at] = np.minimum(length, most)
    # Past the end nothing is shared.
    shared = np.minimum(shared, n - np.maximum(np.arange(n), before))
    return shared[order]
