"""Suffix sorting by linear grouping.

Phase 1 groups suffixes by their Lyndon prefixes. Groups are taken in descending order;
each member's pointer to the previous position of a lower group is found by jumping along
earlier pointers, and the positions pointed to move, within their own group, to a new
group behind those that aren't: their prefix now goes on with this group's. Phase 2 emits
the order: suffixes of one group are ordered by what follows their Lyndon prefix, so one
pass over the growing result places each suffix through the same pointers. No names are
given again and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` in ascending order; a prefix comes before what it begins."""
    m = len(symbols)
    if not m:
        return np.zeros(0, np.int64)
    ranks = np.empty(m + 1, np.int64)
    ranks[:m] = np.unique(symbols, return_inverse=True)[1] + 1
    ranks[m] = 0  # the end is the smallest symbol
    n = m + 1
    by_symbol = np.argsort(ranks, kind="stable")
    sizes = np.bincount(ranks)
    starts = np.cumsum(sizes) - sizes
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    order, where, group = by_symbol.tolist(), place.tolist(), starts[ranks].tolist()
    size = [0] * n
    for a, k in zip(starts.tolist(), sizes.tolist()):
        size[a] = k
    prev = [-1] * n
    end = n - 1
    while end > 0:
        lo = group[order[end]]
        if lo == end:  # one member
            s = order[end]
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                h = group[p]
                k = size[h] - 1
                if k:  # move p to the end of its group, as a group of its own
                    last = h + k
                    q, at = order[last], where[p]
                    order[at], where[q] = q, at
                    order[last], where[p] = p, last
                    size[h] = k
                    group[p] = last
                    size[last] = 1
            end = lo - 1
            continue
        members = order[lo : end + 1]
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > lo:
                p = prev[p]
            prev[s] = p
        times: dict[int, int] = {}
        for s in members:
            p = prev[s]
            if p >= 0 and group[p] == lo:
                path = [s]
                while p >= 0 and group[p] == lo:
                    path.append(p)
                    p = prev[p]
                for q in path:
                    prev[q] = p
        for s in members:
            p = prev[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            classes = [list(times)] if most == 1 else [[p for p, c in times.items() if c == k] for k in sorted(set(times.values()), reverse=True)]
            for ps in classes:  # the more repeats follow, the greater
                for p in ps:
                    h = group[p]
                    size[h] -= 1
                    last = h + size[h]
                    q, at = order[last], where[p]
                    order[at], where[q] = q, at
                    order[last], where[p] = p, last
                moved = [(p, group[p] + size[group[p]]) for p in ps]
                for p, g in moved:
                    group[p] = g
                    size[g] += 1
        end = lo - 1
    result = [0] * n
    result[0] = m
    left = list(range(n))  # next free place, by group start
    placed = bytearray(n)
    placed[m] = 1
    for i in range(n):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            result[left[g]] = s
            left[g] += 1
            placed[s] = 1
            s = prev[s]
    return np.array(result[1:], np.int64)
