"""Suffix arrays of many texts at once by grouping suffixes by their Lyndon prefixes.

A suffix's Lyndon prefix reaches to the next smaller suffix. The first phase
finds these prefixes: suffixes start in groups by their first letter, and the
groups are taken from the highest to the lowest. A group that is taken is
final. Before each run of its members stands the previous smaller suffix that
is left; its prefix grows by the members of the run, so it moves to a group of
its own behind the one it was in, the higher the longer its run. Taken members
are unlinked, which makes the next links the previous and next smaller ones.
The second phase emits suffixes from the lowest: each one emitted is the next
smaller suffix of some others, and they take the next free places of their
groups. No suffix is ever renamed, and no text is compared.

The texts don't touch each other, so a step takes one group of every text, or
emits what one group of every text has got: NumPy then works on all texts, and
the number of steps is that of the text with the most groups.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts`` with ``sizes``, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def heads(values: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def lyndon_groups(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place where a suffix's group begins in its text's order, next smaller suffix) of every position.

    ``codes`` are all texts one behind the other, ``starts`` where each begins;
    each text ends with its only and lowest 0.
    """
    n = len(codes)
    ends = np.append(starts[1:], n)
    lane = np.repeat(np.arange(len(starts), dtype=np.int64), ends - starts)
    key = lane * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable").astype(np.int32)
    first = np.flatnonzero(heads(key[order]))
    sizes = np.diff(np.append(first, n))
    group, place, end = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, np.int32)
    group[order] = np.repeat(first, sizes)
    place[order] = np.arange(n, dtype=np.int32)
    end[first] = first + sizes
    del lane, key
    # Links to the positions left on both sides; n stands for none.
    left, right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    left[starts], right[ends - 1], left[n], right[n] = n, n, n, n
    smaller = np.full(n, n, np.int32)
    chosen = np.zeros(n, bool)
    low, tail = starts.astype(np.int64), ends.astype(np.int64)
    while len(low):
        at = group[order[tail - 1]].astype(np.int64)
        members = np.sort(order[spread(at, tail - at)])
        smaller[members] = right[members]
        before = left[members]
        opens = np.ones(len(members), bool)
        np.not_equal(before[1:], members[:-1], out=opens[1:])
        opens = np.flatnonzero(opens)
        runs = np.diff(np.append(opens, len(members)))
        prev, after = before[opens], right[members[opens + runs - 1]]
        right[prev], left[after] = after, prev
        some = at > low
        low, tail = low[some], at[some]
        real = prev < n
        prev, runs = prev[real], runs[real]
        if not len(prev):
            continue
        # Each previous smaller suffix goes to the end of its group, by the length of its run.
        old = group[prev].astype(np.int64)
        by = np.argsort(old << 32 | runs)
        prev, runs, old = prev[by], runs[by], old[by]
        opens = np.flatnonzero(heads(old))
        count = np.diff(np.append(opens, len(old)))
        cut = end[old[opens]] - count
        slots, floor, was = spread(cut, count), np.repeat(cut, count), place[prev]
        chosen[prev] = True
        there = order[slots]
        there = there[~chosen[there]]
        free = was[was < floor]
        order[free], place[there] = there, free
        order[slots], place[prev] = prev, slots
        chosen[prev] = False
        end[old[opens]] = cut
        opens = np.flatnonzero(heads(old << 32 | runs))
        sizes = np.diff(np.append(opens, len(old)))
        group[prev] = np.repeat(slots[opens], sizes)
        end[slots[opens]] = slots[opens] + sizes
    return group, smaller


def suffix_orders(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions of each text, in the place of the text, by their suffixes."""
    n = len(codes)
    group, smaller = lyndon_groups(codes, starts)
    free = np.arange(n, dtype=np.int32)
    # Who waits for a position, listed behind each other.
    waiting = np.argsort(smaller, kind="stable").astype(np.int32)
    count = np.bincount(smaller, minlength=n + 1)[:n].astype(np.int32)
    listed = (np.cumsum(count, dtype=np.int64) - count).astype(np.int32)
    ends = np.append(starts[1:], n)
    order = np.empty(n, np.int32)
    order[starts] = ends - 1
    free[starts] += 1
    at, last = starts.astype(np.int64), ends.astype(np.int64)
    while len(at):
        # All that the group in turn has got so far; those it gets from itself come with the next step.
        upto = free[group[order[at]]].astype(np.int64)
        now = order[spread(at, upto - at)]
        some = upto < last
        at, last = upto[some], last[some]
        k = count[now]
        some = np.flatnonzero(k)
        now, k = now[some], k[some]
        ready = waiting[spread(listed[now], k)]
        if len(ready):
            g = group[ready]
            by = np.argsort(g, kind="stable")
            g, ready = g[by], ready[by]
            opens = np.flatnonzero(heads(g))
            sizes = np.diff(np.append(opens, len(g)))
            order[spread(free[g[opens]], sizes)] = ready
            free[g[opens]] += sizes.astype(np.int32)
    return order
