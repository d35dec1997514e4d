"""Suffix order by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy."""

from __future__ import annotations

import numpy as np


def order_pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions in order of (high, low); both are non-negative."""
    n = len(high)
    if not n:
        return np.zeros(0, np.int64)
    bits = [int(x).bit_length() for x in (high.max(), low.max(), n - 1)]
    if sum(bits) <= 63:  # value and position in one number: sorting beats arg-sorting
        key = (high << (bits[1] + bits[2])) | (low << bits[2]) | np.arange(n)
        return np.sort(key) & ((1 << bits[2]) - 1)
    return np.lexsort((low, high))


def refine(symbols: np.ndarray, depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` symbols or more, and the rank of each.

    Suffixes that agree so far share a rank, the first place of their group. Each round doubles
    the compared length and sorts only the members of groups that are still open. `step` is the
    number of units that one symbol already holds.
    """
    n = len(symbols)
    symbols = np.asarray(symbols, np.int64)
    order = order_pairs(np.zeros(n, np.int64), symbols)
    sorted_symbols = symbols[order]
    head = np.ones(n, bool)
    head[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0)) if n else place
    known = step
    while known < depth:
        single = head.copy()
        single[:-1] &= head[1:]
        still = np.flatnonzero(~single)
        if not len(still):
            break
        at = order[still]
        after = at + known
        low = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        high = rank[at]
        sort = order_pairs(np.cumsum(head[still]), low)
        at, high, low = at[sort], high[sort], low[sort]
        order[still] = at
        new = np.ones(len(at), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        head[still] = new
        rank[at] = still[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        known *= 2
    return order, rank


def common_prefixes(values: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in `order`, up to `limit`.

    Kasai's rule, the prefix of position i + 1 is at most one shorter than that of i, gives every
    position a floor: the tests double along the text and are carried over as floors.
    """
    n = len(values)
    prefix = np.zeros(n, np.int64)
    if n < 2:
        return prefix
    at, other = order[1:], order[:-1]
    before = np.full(n, -1, np.int64)
    before[at] = other
    length = np.zeros(n, np.int64)  # by position in the text
    position = np.arange(n)
    stride = 1 << max(0, int(limit).bit_length() - 1)
    while stride:
        # every stride-th position is extended from its floor, then hands its value on
        chosen = position[::stride]
        chosen = chosen[before[chosen] >= 0]
        _extend(values, before, length, chosen, limit)
        floor = np.maximum.accumulate(length + position) - position
        length = np.where(before >= 0, np.maximum(length, np.minimum(floor, limit)), 0)
        stride //= 2
    prefix[1:] = length[at]
    return prefix


def _extend(
    values: np.ndarray, before: np.ndarray, length: np.ndarray, at: np.ndarray, limit: int
) -> None:
    n = len(values)
    live = at
    while len(live):
        a, b = live + length[live], before[live] + length[live]
        inside = (a < n) & (b < n) & (length[live] < limit)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[values[a] == values[b]]
        length[live] += 1
