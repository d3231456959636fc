"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

from itertools import accumulate

import numpy as np


def _induced(text: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from ``lms`` in order.

    Buckets of first characters are filled from left to right with larger
    suffixes, then from right to left with smaller ones; all suffixes that one
    step induces move at once. ``small[i]`` says whether suffix i is smaller
    than the next.
    """
    chars = text[lms]
    by_char = np.argsort(chars, kind="stable")
    edges = np.searchsorted(chars[by_char], np.arange(k + 1))
    seeds = [lms[by_char[edges[c] : edges[c + 1]]] for c in range(k)]

    def pass_over(order: range, wanted: bool, other: list[np.ndarray]) -> list[np.ndarray]:
        waiting: list[list[np.ndarray]] = [[] for _ in range(k)]
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * k

        def step(source: np.ndarray, c: int) -> np.ndarray:
            before = source[source > 0] - 1
            before = before[small[before] == wanted]
            first = text[before]
            same = before[first == c]
            away = first != c
            if away.any():
                before, first = before[away], first[away]
                at = np.argsort(first, kind="stable")
                before, first = before[at], first[at]
                cut = np.flatnonzero(np.diff(first)) + 1
                for part, d in zip(np.split(before, cut), first[np.append(0, cut)]):
                    waiting[d].append(part)
            return same

        for c in order:
            front = np.concatenate(waiting[c]) if waiting[c] else done[c]
            parts = []
            while len(front):
                parts.append(front)
                front = step(front, c)
            if parts:
                done[c] = np.concatenate(parts)
            if len(other[c]):
                step(other[c], c)
            waiting[c] = []
        return done

    larger = pass_over(range(k), False, seeds)
    smaller = pass_over(range(k - 1, -1, -1), True, [x[::-1] for x in larger])
    smaller[0] = np.array([len(text) - 1])  # nothing induces the end
    return np.concatenate([p for c in range(k) for p in (larger[c], smaller[c][::-1])])


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is."""
    n = len(text)
    differs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    at = differs[np.searchsorted(differs, np.arange(n))]
    out = np.ones(n, bool)
    inner = at < n - 1
    out[inner] = text[at[inner]] < text[at[inner] + 1]
    return out


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Equal numbers for equal substrings between leftmost smaller suffixes,
    rising in ``ordered``."""
    end = np.append(lms[1:], lms[-1])
    length = np.zeros(len(text), np.int64)
    length[lms] = end - lms + 1
    a, b = ordered[:-1], ordered[1:]
    equal = length[a] == length[b]
    at = np.flatnonzero(equal)
    if len(at):
        sizes = length[a[at]]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ramp = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        same = text[np.repeat(a[at], sizes) + ramp] == text[np.repeat(b[at], sizes) + ramp]
        equal[at] = np.logical_and.reduceat(same, starts)
    return np.concatenate([[0], np.cumsum(~equal)])


def _sorted_list(text: list[int], k: int) -> list[int]:
    """Induced sorting one suffix at a time: for reduced texts, which have nearly
    as many characters as places. The last character is the only 0."""
    n = len(text)
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
    sizes = [0] * k
    for c in text:
        sizes[c] += 1
    ends = list(accumulate(sizes))
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa = [0] * n
        tail = ends.copy()
        for i in reversed(order):
            c = text[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = [e - s for e, s in zip(ends, sizes)]
        for x in range(n):
            j = sa[x] - 1
            if j >= 0 and not small[j]:
                c = text[j]
                sa[head[c]] = j
                head[c] += 1
        tail = ends.copy()
        for x in range(n - 1, -1, -1):
            j = sa[x] - 1
            if j >= 0 and small[j]:
                c = text[j]
                tail[c] -= 1
                sa[tail[c]] = j
        sa[0] = n - 1
        return sa

    if len(lms) < 2:
        return induce(lms)
    array = np.array(text, np.int64)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first = np.array(induce(lms), np.int64)
    return induce(_order(array, np.array(lms, np.int64), first[is_lms[first]]).tolist())


def _order(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The leftmost smaller suffixes in order, from their substrings in order."""
    names = _names(text, lms, ordered)
    if names[-1] + 1 == len(ordered):
        return ordered
    named = np.zeros(len(text), np.int64)
    named[ordered] = names
    return lms[_sorted_list(named[lms].tolist(), int(names[-1]) + 1)]


def suffix_array(text: np.ndarray, k: int) -> np.ndarray:
    """The places of all suffixes in order. Characters are below ``k``; the last
    is the only 0."""
    text = text.astype(np.int64)
    if len(text) < 2:
        return np.arange(len(text))
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = _induced(text, small, k, lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    return _induced(text, small, k, _order(text, lms, first[is_lms[first]]))


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how much its suffix has in common with the one before it
    in order, and the place of that one (-1 for the first).

    A suffix that follows one of the same predecessor has one less in common
    than the suffix before it in the text; only the others are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    i = np.arange(n)
    some = before >= 0
    reducible = some & (i > 0) & (before > 0)
    reducible[reducible] = text[i[reducible] - 1] == text[before[reducible] - 1]
    # the predecessor's own predecessor must stand in the same relation
    reducible[1:] &= before[1:] == before[:-1] + 1
    at = np.flatnonzero(some & ~reducible)
    padded = np.append(text, np.full(16, -1, text.dtype))
    shift = np.arange(16)
    length = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    while len(active):
        x, y = at[active] + length[active], before[at[active]] + length[active]
        same = padded[np.minimum(x, n)[:, None] + shift] == padded[np.minimum(y, n)[:, None] + shift]
        same &= (np.maximum(x, y)[:, None] + shift) < n
        run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        length[active] += run
        active = active[run == 16]
    out[at] = length
    known = np.zeros(n, np.int64)
    known[~reducible] = i[~reducible]
    source = np.maximum.accumulate(known)
    out = np.where(reducible, out[source] - (i - source), out)
    return out, before


def repeated_windows(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For each part, whether the ``width`` bytes from each place occur twice
    anywhere among the parts. Windows lie within a part."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.ones(int(starts[-1]) + 1, np.int16)
    text[-1] = 0
    for part, at in zip(parts, starts):
        text[at : at + len(part)] = np.frombuffer(part, np.uint8).astype(np.int16) + 2
    prefixes, before = common_prefixes(text, suffix_array(text, 258))
    long = prefixes >= width
    # a common prefix may run over the end of a part into the next
    place = np.zeros(len(text), bool)
    for at, size in zip(starts, sizes):
        place[at : at + max(0, size - width + 1)] = True
    hit = np.flatnonzero(long & place)
    hit = hit[place[before[hit]]]
    found = np.zeros(len(text), bool)
    found[hit] = True
    found[before[hit]] = True
    return [found[at : at + max(0, size - width + 1)] for at, size in zip(starts, sizes)]
