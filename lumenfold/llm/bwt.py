"""Suffix order, Burrows-Wheeler transform and threshold-bounded common prefixes of a set of byte strings."""

from __future__ import annotations

import numpy as np


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings as one sequence of symbols, each behind an end of its own, and where each starts. No common prefix
    passes an end."""
    lengths = np.asarray([len(s) for s in strings], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.empty(int(lengths.sum()) + len(strings), dtype=np.int64)
    ends = starts + lengths
    out[ends] = np.arange(len(strings))
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + len(strings)
    return out, starts


def _first_order(symbols: np.ndarray, n_ends: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes ordered by their first symbols, where that order sets them apart, and how many symbols it looks at. An end
    counts as the smallest symbol and hides what is behind it; suffixes that meet theirs are ordered by their strings."""
    n, take = len(symbols), 6
    plain = np.where(symbols < n_ends, 0, symbols - n_ends + 1)  # at most 256: nine bits
    to_end = np.flatnonzero(plain == 0)
    left = to_end[np.searchsorted(to_end, np.arange(n))] - np.arange(n)
    key = plain.copy()
    for i in range(1, take):
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - i] = plain[i:]
        key = key << 9 | np.where(left >= i, nxt, 0)
    order = np.argsort(key)
    short = np.flatnonzero(left[order] < take)
    suffix = order[short]
    order[short] = suffix[np.lexsort((suffix, key[suffix]))]  # equal keys fill neighbouring places, which stay theirs
    ordered = key[order]
    return order, np.append(True, (ordered[1:] != ordered[:-1]) | (left[order[1:]] < take)), take


def suffix_order(symbols: np.ndarray, n_ends: int, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling; equal ones stand in any order.
    Suffixes in groups of one are done; only the others are sorted on."""
    n = len(symbols)
    order, head, known = _first_order(symbols, n_ends)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = np.flatnonzero(~(head & np.append(head[1:], True)))  # places whose suffix is not settled
    while len(at) and known < depth:
        suffix = order[at]
        key = rank[suffix] << 32 | rank[suffix + known]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[at] = suffix  # groups are contiguous and rise, so places stay theirs
        new = np.append(True, key[1:] != key[:-1])
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        known *= 2
        at = at[~(new & np.append(new[1:], True))]
    return order


def long_common_prefixes(symbols: np.ndarray, n_ends: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each place whether its suffix shares ``least`` symbols or more with the one before.

    Common prefixes are derived by rising value, from 0 on, by extending intervals backwards on the transform, breadth
    first. The boundary at j lies between neighbours that follow one symbol in the transform; its value is one more than
    the least of the boundaries between their places there. So each round looks at what the last one settled: a boundary
    between two equal neighbours of the transform settles one other, and boundaries over wider ranges are settled as soon
    as one inside their range is. It stops at ``least``: what is still open shares that much."""
    order = suffix_order(symbols, n_ends, least)
    n = len(order)
    first = symbols[order]
    open_ = np.append(False, first[1:] == first[:-1])
    before = symbols[order - 1]  # the transform; the suffix at 0 is preceded by the last end
    if symbols.max() < 1 << 16:
        before = before.astype(np.uint16)  # sorted by counting
    right = np.argsort(before, kind="stable").astype(np.int32)  # place j of the suffix order comes from this place by one step back
    left = np.append(np.int32(0), right[:-1])
    back = np.empty(n, dtype=np.int32)
    back[right] = np.arange(n, dtype=np.int32)
    alike = np.append(False, before[1:] == before[:-1])
    new = np.flatnonzero(~open_)
    wide = np.flatnonzero(open_ & (right - left > 1))
    lo, hi = left[wide], right[wide]
    for _ in range(1, least):
        if not len(new):
            break
        step = back[new[alike[new]]]
        if len(wide):
            if len(wide) > n >> 4:
                mark = np.zeros(n, dtype=np.int32)
                mark[new] = 1
                passed = np.cumsum(mark, dtype=np.int32)
                hit = passed[hi] > passed[lo]
            else:
                ordered = np.append(np.sort(new), n)
                hit = ordered[np.searchsorted(ordered, lo, side="right")] <= hi
            step = np.concatenate([step, wide[hit]])
            wide, lo, hi = wide[~hit], lo[~hit], hi[~hit]
        open_[step] = False
        new = step
    return order, open_


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, at which starts its next ``least`` bytes stand at another start of these strings too."""
    if not strings:
        return []
    symbols, starts = joined(strings)
    order, shared = long_common_prefixes(symbols, len(strings), least)
    both = shared | np.append(shared[1:], False)
    mask = np.zeros(len(symbols), dtype=bool)
    mask[order[both]] = True
    return [mask[s : s + len(x)] for s, x in zip(starts, strings, strict=True)]
