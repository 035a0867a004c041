"""Linear suffix grouping (after Baier, CPM 2016): a suffix array without recursion or renaming."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(s: Sequence[int]) -> list[int]:
    """The positions of ``s`` in the order of the suffixes that start there; a suffix that ends sorts before one that goes on.

    Phase 1 groups suffixes by their longest Lyndon prefix. Groups start as equal first symbols and are taken in
    descending order. Each member of the group taken points to its previous smaller suffix, the nearest position to the
    left whose group is still to come; that suffix's prefix grows by the group's word, as often as members point to it,
    so it moves to a new group just above its old one, the larger counts above the smaller.

    Phase 2 emits: in ascending order, each suffix gives a place in their groups to those that end their prefix where
    it starts. These are found from the position before it along the pointers.
    """
    n = len(s)
    order = np.argsort(np.asarray(s), kind="stable")
    values = np.asarray(s)[order]
    bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), n] if n else [0]
    members: list[list[int]] = [order[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size = [len(m) for m in members]
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    # left[i + 1]: i + 1 while position i is to come, else a place further left; 0 stands before the text
    left = list(range(n + 1))
    smaller = [0] * n
    rank: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = members[g] if len(members[g]) == size[g] else [i for i in members[g] if group[i] == g]
        members[g] = []
        rank.append(g)
        for i in own:
            left[i + 1] = i
        count: dict[int, int] = {}
        for i in own:
            x = left[i]
            if left[x] != x:
                while left[x] != x:
                    left[x] = x = left[left[x]]
                left[i] = x
            smaller[i] = x - 1
            if x:
                count[x - 1] = count.get(x - 1, 0) + 1
        if count:
            top = max(count.values())
            if top == 1:
                levels = [list(count)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in count.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in sorted(by, reverse=True)]
            for level in levels:
                new: dict[int, int] = {}
                for p in level:
                    o = group[p]
                    if size[o] == 1:  # alone in its group: nothing to tell it from
                        continue
                    m = new.get(o)
                    if m is None:
                        new[o] = m = len(members)
                        members.append([p])
                        size.append(1)
                        below.append(o)
                        above.append(-1)
                    else:
                        members[m].append(p)
                        size[m] += 1
                    group[p] = m
                for o, m in new.items():  # just above the old group
                    size[o] -= size[m]
                    a = above[o]
                    below[a], above[m], above[o] = m, a, m
        g = below[g]

    start, at = [0] * len(size), 0
    for g in reversed(rank):
        start[g] = at
        at += size[g]
    out = [0] * n
    i = n - 1  # the empty suffix comes first
    while i >= 0:
        out[start[group[i]]] = i
        start[group[i]] += 1
        i = smaller[i]
    for k in range(n):
        j = out[k]
        i, stop = j - 1, smaller[j]
        while i != stop:
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            i = smaller[i]
    return out
