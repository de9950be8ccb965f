"""Suffix arrays of many small collections at once, by Lyndon-prefix groups and without recursive renaming."""

from __future__ import annotations

import numpy as np


def lay_out(lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places for the pieces of the collections, each between separators.

    owner is the ascending collection of each piece. Returns the start of each piece, the first and last place of each
    collection, and the value of the separator at each place (-1 elsewhere). In a collection later separators are
    smaller, and the last is its sentinel, 0.
    """
    new = np.r_[True, owner[1:] != owner[:-1]]
    number = np.cumsum(new) - 1
    start = np.cumsum(lengths + 1) - lengths + number  # a separator before each piece, one more after each collection
    pieces = np.bincount(number)
    first = start[np.flatnonzero(new)] - 1
    total = int(lengths.sum() + len(lengths) + len(pieces))
    last = np.r_[first[1:], total] - 1
    separator = np.full(total, -1)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    separator[start - 1] = pieces[number] - nth
    separator[last] = 0
    return start, first, last, separator


def lyndon_groups(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix, named by its first rank, and each suffix's previous smaller one (-1: none).

    Suffixes of a group begin with the same longest Lyndon word. Groups start as equal characters and are taken in
    descending order, one of every collection at a time: each member points to the nearest place before it that is in a
    smaller group, and the places pointed to move up, right behind the rest of their old group, the higher the more
    members point to them, since their Lyndon prefix now takes the members' in as often.
    """
    n = len(keys)
    owner = np.repeat(np.arange(len(first)), last - first + 1)
    sa = np.lexsort((keys, owner))
    new = np.r_[True, (keys[sa][1:] != keys[sa][:-1]) | (owner[sa][1:] != owner[sa][:-1])]
    begin = np.flatnonzero(new)
    group, place, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    group[sa] = np.repeat(begin, np.diff(np.r_[begin, n]))
    place[sa] = np.arange(n)
    size[begin] = np.diff(np.r_[begin, n])
    prev, moved = np.full(n, -1, np.int64), np.zeros(n, bool)
    low, end = first.copy(), last + 1
    while len(end):
        start = group[sa[end - 1]]
        many = end - start
        members = sa[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        own, floor = np.repeat(start, many), np.repeat(low, many)
        p = members - 1
        p[members == floor] = -1
        todo = np.flatnonzero(p >= 0)
        while len(todo):
            at = group[p[todo]]
            todo = todo[at >= own[todo]]
            same = group[p[todo]] == own[todo]
            back = prev[p[todo]]
            step = p[todo] - 1
            step[p[todo] == floor[todo]] = -1
            p[todo] = np.where(same, step, back)
            todo = todo[p[todo] >= 0]
        prev[members] = p
        p = p[p >= 0]
        if len(p):
            p, times = np.unique(p, return_counts=True)
            old = group[p]
            sort = np.lexsort((times, old))
            p, times, old = p[sort], times[sort], old[sort]
            head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            count = np.diff(np.r_[head, len(p)])
            tail = old[head] + size[old[head]] - count
            ranks = np.repeat(tail - head, count) + np.arange(len(p))
            moved[p] = True
            there = sa[ranks]
            displaced = there[~moved[there]]
            vacant = place[p][place[p] < np.repeat(tail, count)]
            sa[vacant], place[displaced] = displaced, vacant
            sa[ranks], place[p] = p, ranks
            moved[p] = False
            size[old[head]] -= count
            part = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            length = np.diff(np.r_[part, len(p)])
            size[ranks[part]] = length
            group[p] = np.repeat(ranks[part], length)
        more = start > low
        low, end = low[more], start[more]
    return group, prev


def suffix_arrays(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The suffixes of each collection in ascending order, in the places first to last; keys hold distinct separators, the last smallest.

    The sentinel comes first. Reading ascending ranks, each suffix sends the one before it, and that one's chain of
    previous smaller suffixes as far as they wait, to the next free rank of their groups. All collections go in step.
    """
    group, prev = lyndon_groups(keys, first, last)
    n = len(keys)
    out, free, waits = np.full(n, -1, np.int64), np.arange(n), np.ones(n, bool)
    out[first], waits[last] = last, False
    rank, low, high, p = first.copy(), first.copy(), last.copy(), last - 1
    p[last == first] = -1
    while len(rank):
        put = (p >= 0) & waits[p]
        at = p[put]
        g = group[at]
        out[free[g]] = at
        free[g] += 1
        waits[at] = False
        p[put] = prev[at]
        rest = ~put
        rank[rest] += 1
        done = rank > high
        if done.any():
            rank, low, high, p, rest = rank[~done], low[~done], high[~done], p[~done], rest[~done]
        s = out[rank[rest]]
        p[rest] = np.where(s > low[rest], s - 1, -1)
    return out
