"""Suffix arrays of many short texts at once, by linear grouping: one group of each text a step.

First all suffixes of a text are put into groups by their first symbol. Groups are then processed from the highest
down: suffixes of a group lend their Lyndon prefix to the nearest suffix before them that lies in a lower group (the
previous-smaller pointer), and so split that one's group by how many lend to it. When the lowest group is done, a
group holds the suffixes of one Lyndon prefix. The second phase reads the array from its front and places, for each
suffix read, those whose Lyndon prefix ends where it starts; no text is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + size), one range after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _lend(parent: np.ndarray, group: np.ndarray, size: np.ndarray, sa: np.ndarray, at: np.ndarray, hit: np.ndarray) -> None:
    """Splits groups: suffixes that several of the processed group point to rise above those with fewer, and those
    above the ones without."""
    found, times = np.unique(parent, return_counts=True)
    own = group[found]
    if times.max() == 1:
        order = np.argsort(own, kind="stable")
    else:
        order = np.lexsort((times, own))
    found, times, own = found[order], times[order], own[order]
    first = np.r_[True, own[1:] != own[:-1]]
    head = np.flatnonzero(first)
    count = np.diff(np.r_[head, len(own)])
    old = own[head]
    target = _spans(old + size[old] - count, count)
    hit[found] = True
    there = sa[target]
    pushed = there[~hit[there]]  # suffixes that must leave the top of their group
    left = at[found]
    freed = left[left < np.repeat(old + size[old] - count, count)]
    sa[freed], at[pushed] = pushed, freed
    sa[target], at[found] = found, target
    hit[found] = False
    block = np.flatnonzero(first | np.r_[True, times[1:] != times[:-1]])
    many = np.diff(np.r_[block, len(own)])
    size[old] -= count
    group[found] = np.repeat(target[block], many)
    size[target[block]] = many


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix array of each text; texts lie one after the other in ``symbols``, each with ``lengths`` symbols of
    which the last is the text's smallest and occurs once. Places count from the front of ``symbols``."""
    n, texts = len(symbols), len(lengths)
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(texts, dtype=np.int64), lengths)
    key = text * (int(symbols.max(initial=0)) + 1) + symbols
    sa = np.argsort(key, kind="stable")
    at = np.empty(n, np.int32)
    at[sa] = np.arange(n)
    head = np.flatnonzero(np.diff(key[sa], prepend=-1))
    size, group = np.zeros(n, np.int32), np.empty(n, np.int32)
    size[head] = np.diff(np.r_[head, n])
    group[sa] = np.repeat(head, size[head])
    before, hit = np.full(n, -1, np.int32), np.zeros(n, bool)
    floor, top = begin.astype(np.int32), (begin + lengths).astype(np.int32)
    while len(top):  # phase 1
        low = group[sa[top - 1]]
        count = top - low
        i = sa[_spans(low, count)]
        mine, least = np.repeat(low, count), np.repeat(floor, count)
        p = i - 1
        open_ = np.flatnonzero((p >= least) & (group[p] > mine))
        while len(open_):
            q = before[p[open_]]
            p[open_] = q
            more = q >= 0
            more[more] = group[q[more]] > mine[open_[more]]
            open_ = open_[more]
        p[p < least] = -1
        before[i] = p
        open_ = np.flatnonzero(p >= 0)
        open_ = open_[group[p[open_]] == mine[open_]]
        while len(open_):  # past neighbours of the same group
            q = before[p[open_]]
            p[open_] = q
            more = q >= 0
            more[more] = group[q[more]] == mine[open_[more]]
            open_ = open_[more]
        before[i] = p
        lent = p[p >= 0]
        if len(lent):
            _lend(lent, group, size, sa, at, hit)
        top = low
        more = top > floor
        if not more.all():
            top, floor = top[more], floor[more]
    out, placed = np.empty(n, np.int32), np.zeros(n, bool)
    free = group.copy()  # at a group's start: where its next suffix goes
    free[group] = group
    end = (begin + lengths).astype(np.int32)
    out[begin] = end - 1
    placed[end - 1] = True
    free[group[end - 1]] += 1
    read, floor = begin.astype(np.int32), begin.astype(np.int32)
    while len(read):  # phase 2
        j = out[read] - 1
        go = np.flatnonzero((j >= floor) & ~placed[j])
        j = j[go]
        while len(j):
            g = group[j]
            to = free[g]
            out[to] = j
            free[g] = to + 1
            placed[j] = True
            j = before[j]
            j = j[j >= 0]
            j = j[~placed[j]]
        read += 1
        more = read < end
        if not more.all():
            read, floor, end = read[more], floor[more], end[more]
    return out
