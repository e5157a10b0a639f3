"""Suffix arrays by linear grouping (no recursion, no renaming between rounds).

First part: suffixes are grouped by a prefix that ends up being their Lyndon
prefix.  Groups are taken in descending order.  Each suffix of the group in hand
looks up its previous smaller one (the nearest place to its left in a lower
group); those grow by the group's prefix, once per suffix that points at them, and
so move, ordered by how often, into new groups behind their old one.

Second part: suffixes are given out in ascending order.  When the suffix i is
placed, the suffix before it and its chain of previous smaller ones follow it
next in their groups, until one is met that has its place.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of `symbols` (whole numbers of 0 or more); a suffix comes before those it is a prefix of."""
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)
    text[:-1] = np.asarray(symbols, np.int64) + 1  # 0 ends the text
    first = np.argsort(text, kind="stable")
    ordered = text[first]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.concatenate([heads, [n]]))
    head_of = np.empty(n, np.int64)
    head_of[first] = np.repeat(heads, sizes)
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    members, place, head = first.tolist(), place.tolist(), head_of.tolist()
    size = [0] * n  # of the group that starts at a place
    for at, many in zip(heads.tolist(), sizes.tolist(), strict=True):
        size[at] = many
    before = [-1] * n  # the previous smaller suffix
    jump = [-1] * n  # the same or a place left of it, which shortens walks
    end = n
    while end > 1:
        low = head[members[end - 1]]
        group = sorted(members[low:end])
        end = low
        pointed: dict[int, int] = {}
        for s in group:
            p = s - 1
            if p >= 0 and head[p] >= low:
                walked = []
                while p >= 0 and head[p] >= low:
                    walked.append(p)
                    p = jump[p]
                for q in walked:
                    jump[q] = p
            before[s] = jump[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves = sorted((head[p], times, p) for p, times in pointed.items()) if len(pointed) > 1 else [(head[p], 1, p) for p in pointed]
        k = len(moves)
        while k:
            old, times, _ = moves[k - 1]
            at = top = last = old + size[old]
            # From behind, each moved suffix trades places with the last of its group that has not moved.
            while k and moves[k - 1][0] == old:
                if moves[k - 1][1] != times:
                    _found(members, head, size, at, top)
                    top, times = at, moves[k - 1][1]
                k -= 1
                p = moves[k][2]
                at -= 1
                q, was = members[at], place[p]
                members[was], place[q] = q, was
                members[at], place[p] = p, at
            if at > old:
                size[old] = at - old
            if at > old or top < last:
                _found(members, head, size, at, top)
    return _placed(n, head, before)


def _found(members: list[int], head: list[int], size: list[int], start: int, stop: int) -> None:
    """A new group at the places from `start` to `stop`."""
    size[start] = stop - start
    for i in range(start, stop):
        head[members[i]] = start


def _placed(n: int, head: list[int], before: list[int]) -> np.ndarray:
    order, free, given = [n - 1] * n, list(range(n)), bytearray(n)
    given[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not given[s]:
            given[s] = 1
            h = head[s]
            order[free[h]] = s
            free[h] += 1
            s = before[s]
    return np.array(order[1:], np.int64)
