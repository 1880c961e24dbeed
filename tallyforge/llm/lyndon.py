"""Suffix order of many short texts at once, by Lyndon-prefix groups.

Two phases without recursive renaming. First, suffixes are grouped by first symbol and groups are processed
in descending order: for every suffix of the group its previous-smaller pointer is found, and the suffixes
pointed to move, by how often, into new groups just above the rest of their own; in the end a group holds the
suffixes with one Lyndon prefix. Second, one ascending pass emits each group's order: the suffixes whose next
smaller suffix has just been placed are those on the pointer chain before it. Texts ("lanes") are independent
and advance together, one group or one place each, so the steps are array operations.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, lane by lane in ascending order.

    ``symbols``: positive integers; ``starts``: first position of each lane and the end. A lane's end counts
    as smaller than any symbol.
    """
    n, lanes = len(symbols), len(starts) - 1
    if n == 0:
        return np.zeros(0, np.int64)
    lane = np.repeat(np.arange(lanes), np.diff(starts))
    # Each lane gets a stop in front (below every group) and an end symbol 0 behind.
    where = np.arange(n) + 2 * lane + 1
    total = n + 2 * lanes
    text, own = np.zeros(total, np.int64), np.zeros(total, np.int64)
    text[where], own[where] = symbols, lane
    stop = starts[:-1] + 2 * np.arange(lanes)
    last = starts[1:] + 2 * np.arange(lanes) + 1
    own[stop] = own[last] = np.arange(lanes)
    real = np.ones(total, bool)
    real[stop] = False
    at = np.flatnonzero(real)
    sa = at[np.lexsort((text[at], own[at]))]
    m = len(sa)
    first = stop - np.arange(lanes)  # where each lane begins in sa
    group = np.full(total, -1, np.int64)  # of a suffix: where its group begins in sa
    new = np.ones(m, bool)
    new[1:] = (text[sa[1:]] != text[sa[:-1]]) | (own[sa[1:]] != own[sa[:-1]])
    begin = np.flatnonzero(new)
    group[sa] = np.repeat(begin, np.diff(np.append(begin, m)))
    size = np.zeros(m, np.int64)
    size[begin] = np.diff(np.append(begin, m))
    place, prev = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    place[sa] = np.arange(m)
    moved = np.zeros(total, bool)
    top = last - np.arange(lanes) - 1  # the highest place not processed yet
    live = np.arange(lanes)
    while len(live):
        g = group[sa[top[live]]]
        count = top[live] - g + 1
        rep = np.repeat(g - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        s = sa[np.arange(len(rep)) + rep]
        own_group = np.repeat(g, count)
        p = s - 1
        go = np.flatnonzero(group[p] > own_group)
        while len(go):
            p[go] = prev[p[go]]
            go = go[group[p[go]] > own_group[go]]
        prev[s] = p
        go = np.flatnonzero(group[p] == own_group)
        while len(go):
            prev[s[go]] = prev[prev[s[go]]]
            go = go[group[prev[s[go]]] == own_group[go]]
        p = prev[s]
        p = p[group[p] >= 0]
        if len(p):
            p, times = np.unique(p, return_counts=True)
            old = group[p]
            order = np.lexsort((times, old))
            p, times, old = p[order], times[order], old[order]
            head = np.ones(len(p), bool)
            head[1:] = old[1:] != old[:-1]
            h = np.flatnonzero(head)
            many = np.diff(np.append(h, len(p)))
            tail = np.repeat(old[h] + size[old[h]] - many, many)
            target = tail + np.arange(len(p)) - np.repeat(h, many)
            moved[p] = True
            there = sa[target]
            out = there[~moved[there]]
            free = place[p][place[p] < tail]
            # Both follow the order of groups, and a group has as many of the one as of the other.
            sa[free], place[out] = out, free
            sa[target], place[p] = p, target
            moved[p] = False
            size[old[h]] -= many
            split = head.copy()
            split[1:] |= times[1:] != times[:-1]
            k = np.flatnonzero(split)
            width = np.diff(np.append(k, len(p)))
            size[target[k]] = width
            group[p] = np.repeat(target[k], width)
        top[live] = g - 1
        live = live[top[live] >= first[live]]
    # Second phase.
    slot = np.arange(m)  # the next free place of the group that begins here
    result, placed = np.full(m, -1, np.int64), np.zeros(total, bool)
    placed[stop] = True
    result[first] = last
    placed[last] = True
    slot[first] += 1
    length = np.append(first[1:], m) - first
    order = np.argsort(-length, kind="stable")
    for i in range(int(length.max())):
        while len(order) and length[order[-1]] <= i:
            order = order[:-1]
        p = result[first[order] + i] - 1
        p = p[~placed[p]]
        while len(p):
            to = group[p]
            result[slot[to]] = p
            slot[to] += 1
            placed[p] = True
            p = prev[p]
            p = p[~placed[p]]
    keep = result[np.setdiff1d(np.arange(m), first, assume_unique=True)]
    return keep - 2 * own[keep] - 1


def repeated_windows(symbols: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, group): the given window starts in suffix order, numbered alike where ``length`` symbols agree."""
    order = suffix_order(symbols, starts)
    wanted = np.zeros(len(symbols), bool)
    wanted[windows] = True
    w = order[wanted[order]]
    lane = np.searchsorted(starts, w, "right")
    view = np.lib.stride_tricks.sliding_window_view(symbols, length)
    same = np.zeros(len(w), bool)
    for i in range(1, len(w), 65536):
        j = min(len(w), i + 65536)
        same[i:j] = (lane[i:j] == lane[i - 1 : j - 1]) & (view[w[i:j]] == view[w[i - 1 : j - 1]]).all(1)
    return w, np.cumsum(~same)
